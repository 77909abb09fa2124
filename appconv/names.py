"""Column names and schemas shared by every operator."""

from pyspark.sql import types as T

# The table and column names of the data model.
UID = "request_uid"
DATE = "request_date"
STORE_ID = "app_gpm_id"
APP = "app_id"
BAG = "appsbag"
OWNED = "app_a1"
TARGET = "app_a0"
BIN = "log_norm_cvu_ROUNDED"
VECTOR = "appOwnCVUEnc"
BINNING = "bining_prediction"

COHORT = ["country_id", "device_os_id", "device_type_id"]

REQUEST_COLUMNS = [
    "request_date",
    "request_uid",
    "display_marketing_name",
    "os_version_id",
    "market_id",
    "device_os_id",
    "country_id",
    "device_type_id",
]

# Grain of the conversion tables: every request column but the user.
SEGMENT = [
    "request_date",
    "market_id",
    "display_marketing_name",
    "os_version_id",
    "country_id",
    "device_type_id",
    "device_os_id",
]

# Coarser grain that feeds the model.
MODEL_SEGMENT = [
    "request_date",
    "display_marketing_name",
    "os_version_id",
    "market_id",
]

FEATURES = [
    "display_marketing_name",
    "os_version_id",
    "market_id",
    "app_id",
    "appOwnCVUEnc",
]

FEED_COLUMNS = [
    "country_id",
    "device_os_id",
    "device_type_id",
    "app_a0",
    "app_a1",
    "A0users",
    "A1users",
    "A1A0users",
    "RONusers",
    "A1A0usersAggTarget",
    "A1usersAggTarget",
    "nCVU",
    "log_norm_cvu_ROUNDED",
]


def _strings(*names: str) -> T.StructType:
    return T.StructType([T.StructField(n, T.StringType()) for n in names])


EVENT_LOG_SCHEMA = _strings("request_uid", "app_gpm_id", "request_date")
APP_MAP_SCHEMA = _strings("app_gpm_id", "app_id")
REQUEST_LOG_SCHEMA = _strings(
    "request_date",
    "request_uid",
    "country_id",
    "device_os_id",
    "os_version_id",
    "display_marketing_name",
    "market_id",
    "device_type_id",
    "constant",
)
