"""Fixed schemas of the trip, firewall and run-log data model (names and types as published)."""

from pyspark.sql import types as T

# The 18 trip columns valid up to March 2009, in file order.
TRIP_COLUMNS = [
    ("vendor_name", T.StringType()),
    ("Trip_Pickup_DateTime", T.TimestampNTZType()),
    ("Trip_Dropoff_DateTime", T.TimestampNTZType()),
    ("Passenger_Count", T.DoubleType()),
    ("Trip_Distance", T.DoubleType()),
    ("Start_Lon", T.DoubleType()),
    ("Start_Lat", T.DoubleType()),
    ("Rate_Code", T.StringType()),
    ("store_and_forward", T.StringType()),
    ("End_Lon", T.DoubleType()),
    ("End_Lat", T.DoubleType()),
    ("Payment_Type", T.StringType()),
    ("Fare_Amt", T.DoubleType()),
    ("surcharge", T.DoubleType()),
    ("mta_tax", T.StringType()),
    ("Tip_Amt", T.DoubleType()),
    ("Tolls_Amt", T.DoubleType()),
    ("Total_Amt", T.DoubleType()),
]

TRIP_SCHEMA = T.StructType([T.StructField(n, t, True) for n, t in TRIP_COLUMNS])


def trip_schema(with_id: bool = False) -> T.StructType:
    """Trip schema, optionally led by a ``trip_id`` long."""
    fields = list(TRIP_SCHEMA.fields)
    if with_id:
        fields = [T.StructField("trip_id", T.LongType(), True)] + fields
    return T.StructType(fields)


# The 48 firewall log columns in file order.
FIREWALL_COLUMNS = [
    ("ident", "double"), ("servername", "string"), ("logTime", "timestamp"), ("protocol", "string"),
    ("SourceIP", "string"), ("SourceIP_int8", "flag"), ("SourcePort", "flag"), ("SourceIP_LocID", "flag"),
    ("DestinationIP", "string"), ("DestinationIP_int8", "flag"), ("DestinationPort", "flag"), ("DestinationIP_LocID", "flag"),
    ("OriginalClientIP", "string"), ("OriginalClientIP_int8", "flag"), ("OriginalClientIP_LocID", "flag"),
    ("SourceNetwork", "string"), ("DestinationNetwork", "string"), ("Action", "string"), ("resultcode", "string"), ("rule", "string"),
    ("ApplicationProtocol", "string"), ("bytessent", "double"), ("bytesrecvd", "double"), ("connectiontime", "flag"),
    ("DestinationName", "flag"), ("ClientUserName", "string"), ("ClientAgent", "string"), ("sessionid", "double"),
    ("connectionid", "double"), ("Interface", "flag"), ("IPHeader", "flag"), ("Payload", "flag"), ("GmtLogTime", "flag"),
    ("ipsScanResult", "flag"), ("ipsSignature", "flag"), ("NATAddress", "flag"), ("FwcClientFqdn", "flag"), ("FwcAppPath", "flag"),
    ("FwcAppSHA1Hash", "flag"), ("FwcAppTrusState", "flag"), ("FwcAppInternalName", "flag"), ("FwcAppProductName", "flag"),
    ("FwcAppProductVersion", "flag"), ("FwcAppFileVersion", "flag"), ("FwcAppOrgFileName", "flag"), ("InternalServiceInfo", "flag"),
    ("ipsApplicationProtocol", "flag"), ("FwcVersion", "flag"),
]
FIREWALL_FLAGS = [name for name, kind in FIREWALL_COLUMNS if kind == "flag"]


def firewall_schema() -> T.StructType:
    """Firewall schema in file order; boolean flags are read as strings and typed on demand."""
    kinds = {"double": T.DoubleType(), "timestamp": T.TimestampNTZType(), "string": T.StringType(), "flag": T.StringType()}
    return T.StructType([T.StructField(name, kinds[kind]) for name, kind in FIREWALL_COLUMNS])


# The run-log row written per timed step.
RUNLOG_SCHEMA = T.StructType([
    T.StructField("action", T.StringType()),
    T.StructField("runtime", T.DoubleType()),
    T.StructField("timestamp", T.TimestampNTZType()),
    T.StructField("run_env", T.StringType()),
    T.StructField("run_ram", T.StringType()),
    T.StructField("n_row", T.DoubleType()),
    T.StructField("filesize", T.DoubleType()),
])
