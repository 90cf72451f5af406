"""Names, thresholds and default parameters.

Everything here must keep its value for results to come out right; nothing is derived.
"""

# Column name inside Spark -> name shown to users. Dots in column names need
# quoting everywhere in Spark, so the dotted names appear only at the edges.
MEASURE_LABELS = {
    "pm2_5": "PM2.5",
    "pm10": "PM10",
    "no2": "NO2",
    "so2": "SO2",
    "co": "CO",
    "o3": "O3",
}
MEASURES = tuple(MEASURE_LABELS)

# Descriptive columns that are kept next to the measures.
META_COLUMNS = ("city", "location", "station")

# (concentration low, concentration high, index low, index high) for PM2.5.
PM25_BREAKPOINTS = (
    (0.0, 12.0, 0, 50),
    (12.1, 35.4, 51, 100),
    (35.5, 55.4, 101, 150),
    (55.5, 150.4, 151, 200),
    (150.5, 250.4, 201, 300),
    (250.5, 500.0, 301, 500),
)
AQI_OUT_OF_TABLE = 500

# (index up to and including, category, colour); None is the open last band.
AQI_CATEGORIES = (
    (50, "Good", "green"),
    (100, "Moderate", "yellow"),
    (150, "Unhealthy for Sensitive Groups", "orange"),
    (200, "Unhealthy", "red"),
    (300, "Very Unhealthy", "purple"),
    (None, "Hazardous", "maroon"),
)
HEALTH_ADVICE = (
    (50, "Air quality is good. Enjoy outdoor activities!"),
    (100, "Air quality is moderate. Sensitive individuals should consider reducing prolonged outdoor exertion."),
    (150, "Unhealthy for sensitive groups. Reduce prolonged or heavy outdoor exertion."),
    (None, "Air quality is unhealthy. Avoid outdoor activities and stay indoors."),
)
AQI_ALERT_THRESHOLD = 100

QUALITY_ADVICE = {
    "Good": "Data quality is excellent for predictive modeling",
    "Fair": "Data quality is acceptable with minor gaps",
    "Poor": "Data quality concerns detected",
}
MISSING_CAUTION = "Significant missing data detected - use interpolated values with caution"

VALID_RANGES = {
    "pm2_5": (0.0, 500.0),
    "pm10": (0.0, 1000.0),
    "no2": (0.0, 500.0),
    "so2": (0.0, 500.0),
    "co": (0.0, 50.0),
    "o3": (0.0, 500.0),
}

# Date formats tried in this order after ISO-8601; the order decides ambiguous days.
DATETIME_FORMATS = (
    "yyyy-MM-dd HH:mm:ss",
    "dd/MM/yyyy HH:mm",
    "MM/dd/yyyy HH:mm",
    "yyyy-MM-dd",
    "dd-MM-yyyy",
    "dd/MM/yyyy",
    "MM/dd/yyyy",
)
DATETIME_MIN_SHARE = 0.8
DATETIME_NAME_PARTS = ("date", "time", "timestamp", "dt", "datetime")
DATETIME_NAME_PARTS_UPLOAD = ("date", "time")

MIN_UPLOAD_ROWS = 50
HIGH_MISSING_SHARE = 0.5

IQR_K_CAP = 3.0
IQR_K_REPORT = 1.5
PERCENTILES = (0.10, 0.25, 0.50, 0.75, 0.90, 0.95, 0.99)
HISTOGRAM_BINS = 50
MIN_POSITIVE = 0.1

LAGS = (1, 3, 6, 12, 24)
ROLLING_WINDOWS = (3, 6, 12, 24)
LOOKBACK = 24
TEST_SHARE = 0.2
VALIDATION_SHARE = 0.1
RATIO_EPSILON = 1e-6

GBT_TREES = 100
GBT_DEPTH = 6
GBT_STEP = 0.1
GBT_SUBSAMPLE = 0.8
GBT_FEATURE_SHARE = "0.8"
GBT_SEED = 42

FORECAST_HOURS = 24
FORECAST_MAX_HOURS = 168
HISTORY_ROWS = 168

WEEKDAYS = ("Monday", "Tuesday", "Wednesday", "Thursday", "Friday", "Saturday", "Sunday")
MONTHS = (
    "January", "February", "March", "April", "May", "June",
    "July", "August", "September", "October", "November", "December",
)
