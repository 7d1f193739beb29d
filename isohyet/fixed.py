"""Names, windows and thresholds that results depend on."""

# Measured columns of the daily panel, in storage order.
MEASURES = [
    "prec", "surf_pre", "humidity", "tmp", "dp_tmp", "wb_tmp", "tmp_max", "tmp_min",
    "tmp_range", "surf_tmp", "wind", "wind_max", "wind_min", "wind_range",
]

# Forecast set-up.
HORIZONS = 5
GAP_DAYS = 91
LABEL_MIN, LABEL_MAX = 0.0, 5.0
DEFAULT_ORIGINS = (5, 13, 26)
HISTORY_DAYS = 750

# Thresholds of the daily flags.
DRY_BELOW = 0.1
RAIN_FROM = 1.0
HEAVY_FROM = 10.0
HOT_FROM = 30.0
VERY_HOT_FROM = 35.0

# Days before the first of each month in a 365-day year (index 0 unused).
MONTH_STARTS = [0, 0, 31, 59, 90, 120, 151, 181, 212, 243, 273, 304, 334]

# Look-back windows of the feature profiles.
PROFILES = {
    "full": {
        "columns": MEASURES,
        "lags": [7, 14, 21, 28, 35, 42, 49],
        "rolls": [7, 14, 21, 28, 35],
        "spans": [3, 7, 14],
        "domain": [7, 14, 21, 28, 35],
        "long": [30, 60, 90, 180, 270, 365, 540, 730],
        "label_lags": [0, 1, 2, 3, 4, 6, 8, 12, 26, 52],
        "label_windows": [28, 91, 182, 365, 728],
    },
    "lean": {
        "columns": MEASURES,
        "lags": [7, 14, 21, 28, 35, 42, 49],
        "rolls": [7, 14, 21, 28, 35],
        "spans": [3, 7, 14],
        "domain": [7, 14, 21, 28, 35],
        "long": [91, 180],
        "label_lags": [0, 1, 2, 4, 8, 12, 26, 52],
        "label_windows": [91, 182, 365],
    },
    "micro": {
        "columns": ["prec", "humidity", "tmp", "dp_tmp", "tmp_max", "tmp_range", "surf_pre"],
        "lags": [28, 49],
        "rolls": [28, 35],
        "spans": [14],
        "domain": [35],
        "long": [91],
        "label_lags": [0, 4, 12, 26, 52],
        "label_windows": [91, 365],
    },
}
STREAK_WINDOWS = [30, 60, 90]
HEAT_COUNT_WINDOWS = [30, 60, 90, 180]
HEAT_SUM_WINDOWS = [30, 60, 90]
INSTABILITY_WINDOWS = [14, 30, 60]
VAPOR_WINDOWS = [14, 30]
MOMENTUM_DAYS = [14, 28]
LONGEST_FIXED_WINDOW = 180

# Climatology columns and label-prior settings.
CLIMATE_COLUMNS = ["prec", "tmp", "tmp_max", "humidity", "tmp_range"]
RECENT_DAYS = [365, 730]
PRIOR_STRENGTH = 12.0

# Columns of the drift comparison.
DRIFT_RAW = ["prec", "humidity", "tmp", "dp_tmp", "wb_tmp", "tmp_max", "tmp_min", "tmp_range", "surf_tmp", "wind"]
DRIFT_DAILY = [
    "dry_day", "rain_day_ge_1", "heavy_precip_ge_10", "dew_point_depression",
    "wet_bulb_depression", "surf_air_temp_diff", "dryness_idx_daily", "heat_humidity_idx_daily",
]
DRIFT_ROLLING = [
    "prec_sum_30d", "prec_sum_90d", "prec_sum_180d", "dry_days_30d", "dry_days_90d", "dry_share_90d",
    "rain_days_90d", "hot_days_90d", "tmp_mean_90d", "humidity_mean_90d", "dew_depression_mean_90d",
    "wet_bulb_depression_mean_90d", "max_dry_streak_90d", "rolling_drought_idx_90d",
]
DRIFT_COLUMNS = DRIFT_RAW + DRIFT_DAILY + DRIFT_ROLLING
DRIFT_TREE_COLUMNS = [
    "prec", "humidity", "tmp", "dp_tmp", "tmp_max", "tmp_range", "wind", "dry_day", "dew_point_depression",
    "prec_sum_90d", "dry_days_90d", "tmp_mean_90d", "humidity_mean_90d", "max_dry_streak_90d",
]

# Column-name rules of the feature groups (regular expressions).
FEATURE_GROUPS = {
    "calendar": r"^(month|quarter|dayofmonth|dayofyear|weekofyear|sin_doy|cos_doy|sin_mon|cos_mon)$",
    "short_lag": r"^(?!score_gap).*_lag",
    "rolling": r"(_rmean|_rstd)|^(tmp_range_std_|wind_std_)",
    "ewm": r"_ewm",
    "long_drought_proxy": (
        r"^(prec_sum|dry_days|hot_days|tmp_mean_long|long_drought_idx|consecutive_dry_days"
        r"|cdd_rolling|heat_stress_sum)"
    ),
    "domain_indices": (
        r"^(drought_idx|dryness_idx|heat_humidity_idx|dewpoint_spread|wetbulb_spread|surf_air_temp_diff"
        r"|dew_point_depression|wet_bulb_depression|surf_air_diff_mean|dew_depression_mean)"
    ),
    "climatology": r"_clim_|_anom$",
    "score_history": r"^(score_gap|last_known_score|score_velocity|score_momentum)",
    "region_stats": r"^region_(?!id$)",
    "region_id": r"^region_id$",
}
