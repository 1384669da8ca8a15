"""Fixed values of the domain. They must equal the published tables for results to agree."""

# --- fixed values: telemetry quality rules -------------------------------------------------------------------------
NULL_TOKENS = ["", " ", "null", "none", "nan", "na", "n/a", "-"]
SENTINELS = [-999.0, -9999.0]
ERROR_FLAGS = ["E", "M", "B", "ERR", "ERROR", "NULL"]
PHYSICAL_BOUNDS = {"hourly_rain": (0.0, 300.0), "pressure": (850.0, 1050.0), "humidity": (0.0, 100.0)}
VALUE_COLUMNS = {
    "rain": "hourly_rain", "rainfall_1h": "hourly_rain", "rainfall": "hourly_rain",
    "press": "pressure", "pressure": "pressure", "humid": "humidity", "humidity": "humidity",
}
CATALOGS = ["hourly_rain", "pressure", "humidity"]
TIER_GOLDEN, TIER_SILVER, TIER_BRONZE, TIER_EXCLUDED = (
    "Tier 1: Golden", "Tier 2: Silver", "Tier 3: Bronze", "Tier 4: Excluded")
LOCAL_UTC_OFFSET_HOURS = 7

# --- fixed values: forecast sanity limits and defaults --------------------------------------------------------------
CLIP_LIMITS = {"sp": (800.0, 1050.0), "t2m": (-10.0, 50.0), "tp": (0.0, 300.0), "cape": (0.0, None)}
HOURLY_DEFAULTS = {"precipitation": 0.0, "surface_pressure": 1010.0, "temperature_2m": 25.0,
                   "wind_speed_10m": 0.0, "wind_direction_10m": 0.0, "cape": 0.0}
SATELLITE_DEFAULTS = {"bt_mean_t0": 285.0, "bt_min_t0": 280.0, "bt_std": 1.5, "delta_bt_30": 0.0,
                      "is_rapid_cooling": False, "is_deep_convective": False, "wv_mean": 245.0}
VERIFICATION_ALIASES = {
    "gfs": "ncep_gfs", "ncep": "ncep_gfs", "kwbc": "ncep_gfs", "ncep_gfs": "ncep_gfs",
    "ecmwf": "ecmwf_ifs", "ecmf": "ecmwf_ifs", "ecmwf_ifs": "ecmwf_ifs",
    "icon": "dwd_icon", "dwd": "dwd_icon", "dwd_icon": "dwd_icon",
    "jma": "jma_gsm", "jma_gsm": "jma_gsm",
    "gem": "cmc_gem", "cmc": "cmc_gem", "cmc_gem": "cmc_gem",
    "access": "bom_access", "bom": "bom_access", "bom_access": "bom_access",
}
ACQUISITION_ALIASES = {
    "ecmwf_ifs": "ecmwf_ifs", "ecmwf": "ecmwf_ifs", "ecmf": "ecmwf_ifs",
    "gfs": "gfs", "gfs_seamless": "gfs", "gfs_global": "gfs", "ncep": "gfs", "kwbc": "gfs",
    "jma_gsm": "jma_gsm", "jma": "jma_gsm", "rjtd": "jma_gsm",
}

ARCHIVE_ALIASES = {
    "ecmf": "ecmwf", "ecmwf": "ecmwf", "kwbc": "ncep", "ncep": "ncep", "cwao": "eccc", "cmc": "eccc", "eccc": "eccc",
    "ammc": "bom", "bom": "bom", "edzw": "dwd", "dwd": "dwd",
}
MODEL_LABELS = {"ecmwf_ifs": "ECMWF IFS", "ncep_gfs": "NCEP GFS", "dwd_icon": "DWD ICON"}

# --- fixed values: space --------------------------------------------------------------------------------------------
STATION_BOX = (5.0, 21.5, 96.5, 106.5)
LAND_OUTER_BOX = (5.6, 20.4, 97.4, 105.6)
PENINSULA_BOX = (12.0, 98.2, 102.0)
GRID_CORNER_BOX = (5.5, 20.5, 97.3, 105.7)
SATELLITE_GRID = {"lat0": 5.5, "nlat": 31, "lon0": 97.0, "nlon": 18, "step": 0.5, "margin": 0.5}
SATELLITE_CUTOVER = "2022-12-13 05:00:00"
EARTH_ROTATION = 7.2921159e-5
COAST_KM_PER_DEGREE = 111.13
COAST_CLIP_KM = (0.5, 750.0)
COAST_VERTICES = [
    # west coast, north to south
    (9.97, 98.62), (9.50, 98.48), (9.00, 98.35), (8.50, 98.25), (8.00, 98.30), (7.88, 98.39), (7.75, 98.75),
    (7.50, 99.10), (7.15, 99.45), (6.80, 99.80), (6.50, 100.05),
    # upper gulf, west side
    (10.50, 99.18), (11.00, 99.45), (11.50, 99.65), (11.80, 99.80), (12.25, 100.00), (12.60, 100.00),
    (13.15, 100.02), (13.35, 100.00),
    # inner gulf
    (13.50, 100.25), (13.52, 100.58), (13.45, 100.95), (13.10, 100.90),
    # eastern seaboard
    (12.67, 101.28), (12.60, 101.65), (12.50, 102.00), (12.20, 102.30), (11.90, 102.75), (11.65, 102.90),
    # lower gulf
    (9.90, 99.20), (9.40, 99.25), (9.15, 99.35), (9.20, 99.75), (8.85, 99.95), (8.50, 100.10), (8.00, 100.25),
    (7.50, 100.40), (7.20, 100.60), (6.90, 101.25), (6.60, 101.65), (6.25, 102.05),
]

# --- fixed values: feature names ------------------------------------------------------------------------------------
NWP_FEATURES = ["nwp_rain_raw", "nwp_pressure", "nwp_temp_2m", "nwp_u10", "nwp_v10", "nwp_cape", "lead_time_hours"]
TERRAIN_FEATURES = ["elevation_m", "elevation_std", "slope_deg", "aspect_sin", "aspect_cos", "dist_coast_km",
                    "coriolis_param"]
GROUND_DEFAULTS = {
    "rain_mean_2_5km": 0.0, "rain_max_2_5km": 0.0,
    "pressure_mean_2_5km": 1010.0, "pressure_std_2_5km": 0.0,
    "humidity_mean_2_5km": 70.0, "humidity_std_2_5km": 0.0,
    "nearest_stn_dist_2_5km": 5.0, "nearest_stn_bearing_sin": 0.0, "nearest_stn_bearing_cos": 1.0,
    "rain_mean_5_10km": 0.0, "rain_max_5_10km": 0.0,
    "pressure_mean_5_10km": 1010.0, "humidity_mean_5_10km": 70.0,
    "pressure_mean_20_50km": 1010.0, "humidity_mean_20_50km": 70.0,
    "pressure_gradient_mag": 0.0, "humidity_gradient_mag": 0.0,
    "nearest_rain_val": 0.0, "nearest_rain_dist_km": 50.0,
    "nearest_rain_bearing_sin": 0.0, "nearest_rain_bearing_cos": 1.0,
    "nearest_pressure_val": 1010.0, "nearest_pressure_dist_km": 50.0,
    "nearest_pressure_bearing_sin": 0.0, "nearest_pressure_bearing_cos": 1.0,
    "nearest_humidity_val": 70.0, "nearest_humidity_dist_km": 50.0,
    "nearest_humidity_bearing_sin": 0.0, "nearest_humidity_bearing_cos": 1.0,
}
GROUND_FEATURES = list(GROUND_DEFAULTS)
SATELLITE_FEATURES = ["bt_mean_t0", "bt_min_t0", "bt_std", "bt_mean_lag10m", "bt_mean_lag20m", "bt_mean_lag30m",
                      "delta_bt_30", "wv_mean"]
ABLATIONS = {
    "m1": NWP_FEATURES + TERRAIN_FEATURES + GROUND_FEATURES,
    "m2": NWP_FEATURES + TERRAIN_FEATURES + SATELLITE_FEATURES,
    "m3": NWP_FEATURES + TERRAIN_FEATURES + GROUND_FEATURES + SATELLITE_FEATURES,
}
NWP_RENAMES = {"tp": "nwp_rain_raw", "t2m": "nwp_temp_2m", "sp": "nwp_pressure", "u10": "nwp_u10", "v10": "nwp_v10",
               "cape": "nwp_cape", "lat": "target_lat", "lon": "target_lon"}
RUN_COLUMNS = ["origin", "run_time", "valid_time", "lead_time_hours", "grid_id", "lat", "lon", "tp", "sp", "t2m",
               "u10", "v10", "cape"]
RAIN_THRESHOLDS = [0.1, 2.0, 10.0, 20.0]
QUANTILES = [0.10, 0.50, 0.90, 0.95]
FROZEN_YEAR = 2025
