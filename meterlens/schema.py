"""Column names and schemas shared by every module."""

from __future__ import annotations

from pyspark.sql import types as T

CLIENT, TS, SEGMENT = "client_id", "ts", "segment"
VOLUME, PRESSURE, TEMPERATURE = "volume", "pressure", "temperature"
ORD = "src_ord"
MEASURES = [VOLUME, PRESSURE, TEMPERATURE]
REQUIRED = [CLIENT, TS, VOLUME, PRESSURE, TEMPERATURE]

COMMERCIAL, INDUSTRIAL = "Comercial", "Industrial"
DEFAULT_SEGMENT = COMMERCIAL

READINGS = T.StructType(
    [
        T.StructField(CLIENT, T.StringType()),
        T.StructField(TS, T.TimestampNTZType()),
        T.StructField(SEGMENT, T.StringType()),
        T.StructField(PRESSURE, T.DoubleType()),
        T.StructField(TEMPERATURE, T.DoubleType()),
        T.StructField(VOLUME, T.DoubleType()),
        T.StructField(ORD, T.LongType()),
    ]
)

# The headers of the files users bring and expect back.
EXTERNAL_NAMES = {
    CLIENT: "Cliente",
    TS: "Fecha",
    SEGMENT: "Segmento",
    PRESSURE: "Presion",
    TEMPERATURE: "Temperatura",
    VOLUME: "Volumen",
    "v_filt": "V_filt",
    "volume_next": "Volumen_next",
    "volume_hat": "Volumen_hat",
    "flag_if": "Flag_IF",
    "flag_z": "Flag_Z",
    "flag_final": "Flag_Final",
    "severity": "Severidad",
}

# Header spellings accepted for the client and the timestamp, first hit wins.
CLIENT_ALIASES = [
    "cliente", "client", "clients", "idcliente", "id_cliente", "customer", "usuario", "meter", "medidor",
]
DATE_ALIASES = ["fecha", "date", "fechahora", "fecha_hora", "datetime", "timestamp", "fecha hora"]
STRICT_DATE_ALIASES = ["fecha", "date", "datetime", "fecha_hora", "fechahora"]

# Names under which an evaluation label may arrive, in order.
LABEL_NAMES = ["label", "labels", "is_anom", "anom", "anomaly", "is_anomaly", "target", "y"]

RESIDUAL_FEATURES = ["z_abs", "resid", "r_mean", "r_std", "dz_abs", "dr_abs"]


class MissingColumns(ValueError):
    """A required column is absent."""
