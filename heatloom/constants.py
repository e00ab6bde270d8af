"""Fixed values of the heat-risk model.

Everything in this module is a published coefficient, a threshold or a lookup
entry that results depend on.  The values are stated plainly and are not
derived; behaviour lives in the operator modules.
"""

from __future__ import annotations

# --- grid ------------------------------------------------------------------
CELL_SIZE_M = 100.0
M_PER_DEGREE = 111_320.0
EARTH_RADIUS_M = 6_371_008.8
WEB_MERCATOR_RADIUS_M = 6_378_137.0

# --- scene processing --------------------------------------------------------
LANDSAT_SR_SCALE = 0.0000275
LANDSAT_SR_OFFSET = -0.2
LANDSAT_ST_SCALE = 0.00341802
LANDSAT_ST_OFFSET = 149.0
KELVIN = 273.15
ALBEDO_COEFFS = {"sr_b2": 0.356, "sr_b4": 0.130, "sr_b5": 0.373, "sr_b6": 0.085, "sr_b7": 0.072}
ALBEDO_INTERCEPT = -0.0018
LANDSAT_MAX_CLOUD = 15.0
LANDSAT_RELAXED_CLOUD = 30.0
LANDSAT_COUNT_CLOUD = 70.0
QA_STRICT_BITS = 26  # dilated cloud (bit 1), cloud (bit 3), cloud shadow (bit 4)
QA_CLOUD_BIT = 8
LST_PERCENTILE = 0.90
S2_MAX_CLOUD = 30.0
S2_SCL_MASK = [3, 8, 9, 10, 11]
HANSEN_LAST_LOSS_YEAR = 23
GHS_CELL_AREA_M2 = 10_000.0
GHS_BUILT_EPOCHS = [1975, 1980, 1985, 1990, 1995, 2000, 2005, 2010, 2015, 2020, 2025]
GHS_HEIGHT_EPOCH = 2018
NODATA_SENTINELS = [-9999, -9998, -32768, 65535]
NODATA = -9999.0

# --- indicators --------------------------------------------------------------
HAZARD_WEIGHTS = {"lst": 0.50, "albedo": 0.25, "uhi": 0.25}
EXPOSURE_WEIGHTS = {"population": 0.70, "built_frac": 0.30}
SENSITIVITY_WEIGHTS = {"elderly_frac": 0.30, "child_frac": 0.25, "impervious": 0.25, "cropland": 0.20}
ADAPTIVE_WEIGHTS = {"ndvi": 0.20, "tree_cover": 0.20, "canopy_height": 0.20, "ndwi": 0.20, "viirs_dnb": 0.20}
SUB_INDEX_WEIGHTS = {
    "hazard": HAZARD_WEIGHTS,
    "exposure": EXPOSURE_WEIGHTS,
    "sensitivity": SENSITIVITY_WEIGHTS,
    "adaptive_capacity": ADAPTIVE_WEIGHTS,
}
SUB_INDEX_COLUMN = {"hazard": "h_s", "exposure": "e", "sensitivity": "s", "adaptive_capacity": "ac"}
INDICATORS = [
    "lst", "albedo", "uhi", "population", "built_frac", "elderly_frac", "child_frac",
    "impervious", "cropland", "ndvi", "ndwi", "tree_cover", "canopy_height", "viirs_dnb",
]
INDICATOR_DIRECTIONS = {name: "positive" for name in INDICATORS}
BAND_RANGES = {
    "lst": (-20.0, 80.0), "albedo": (0.01, 0.95), "uhi": (-8.0, 25.0), "population": (0.0, 1e7),
    "built_frac": (0.0, 1.0), "elderly_frac": (0.0, 0.7), "child_frac": (0.0, 0.5),
    "impervious": (0.0, 1.0), "cropland": (0.0, 1.0), "ndvi": (-0.15, 0.95), "ndwi": (-0.70, 0.70),
    "tree_cover": (0.0, 100.0), "canopy_height": (0.0, 60.0), "viirs_dnb": (0.0, 200.0),
}
NON_CRITICAL_BANDS = ["canopy_height"]
MIN_VALID_FRACTION = 0.30
CLIP_PERCENTILES = (0.02, 0.98)
FLAT_SPAN = 1e-12
AC_FLOOR = 0.01
WEIGHT_SHIFT = 0.20
MIN_SHIFTED_WEIGHT = 0.01
BAND_NOISE = {
    "lst": ("gaussian", 0.40), "albedo": ("gaussian", 0.02), "uhi": ("gaussian", 0.50),
    "population": ("lognormal", 0.15), "built_frac": ("gaussian", 0.05),
    "elderly_frac": ("gaussian", 0.02), "child_frac": ("gaussian", 0.01),
    "impervious": ("gaussian", 0.05), "cropland": ("gaussian", 0.04),
    "ndvi": ("gaussian", 0.03), "ndwi": ("gaussian", 0.03), "tree_cover": ("gaussian", 5.00),
    "canopy_height": ("gaussian", 6.60), "viirs_dnb": ("lognormal", 0.10),
}

# --- mortality ---------------------------------------------------------------
BETA_BY_ZONE = {"A": 0.0072, "B": 0.0058, "C": 0.0041, "D": 0.0033, "E": 0.0025}
KOPPEN_LIMITS = [(25.0, "A"), (35.0, "B"), (55.0, "C"), (70.0, "D")]
MMT_PERCENTILE = 0.75
MMT_FALLBACK_C = 30.0
MMT_SIGMA_C = 3.0
LAMBDA_HVI = 0.50
LAMBDA_RANGE = (0.30, 0.80)
CDR_DEFAULT = 0.0074
EVENT_DAYS = 3

# --- season and forecast -----------------------------------------------------
N_HOTTEST_MONTHS = 2
MAX_WINDOW_MONTHS = 5
MIN_SCENES = 3
HEATWAVE_EXCESS_C = 3.0
HEATWAVE_DAYS = 3
HEAT_INDEX_FROM_C = 27.0
FALLBACK_HEAT_INDEX = {"mean_hi_c": 38.0, "max_hi_c": 44.0, "p90_hi_c": 43.0}
DEFAULT_MONTH_T_C = 35.0
DEFAULT_MONTH_TD_C = 22.0

# --- zones -------------------------------------------------------------------
MOORE_MAX_CELLS = 9
DIRECT_MAX_CELLS = 500
MESO_MAX_CELLS = 5_000
MOORE_OFFSETS = [  # (row step, col step, role, weight)
    (0, 0, "primary", 1.00),
    (1, 0, "neighbor", 0.65), (-1, 0, "neighbor", 0.65), (0, 1, "neighbor", 0.65), (0, -1, "neighbor", 0.65),
    (1, 1, "neighbor", 0.45), (1, -1, "neighbor", 0.45), (-1, 1, "neighbor", 0.45), (-1, -1, "neighbor", 0.45),
]
N_MESO_ZONES = 15
N_MACRO_ZONES = 30
FIRST_YEAR = 2016
HUGE_AOI_KM2 = 1_000_000.0

# --- feasibility -------------------------------------------------------------
WATER_LABEL, FLOODED_LABEL, BUILT_LABEL, SNOW_LABEL = 0, 3, 6, 8
NON_PRESCRIBABLE_LABELS = [0, 3, 8]
MIN_POPULATION = 1.0
ROOF_MIN_BUILT = 0.30
ROOF_MAX_HEIGHT_M = 20.0
MISTING_MIN_BUILT = 0.30
WELFARE_MIN_ELDERLY = 0.10
SHADE_MAX_CANOPY_M = 3.0
TREE_MIN_OPEN = 0.10
BGI_MIN_OPEN = 0.20
BGI_MAX_HEIGHT_M = 5.0
PAVEMENT_MIN_BUILT = 0.40
MORPHOLOGY_BUILT = (0.20, 0.80)

# --- planning ----------------------------------------------------------------
CARBON_PRICE_USD = 80.0
STORMWATER_USD_PER_M3 = 2.5
PLAN_DRAWS = 50
SHORT_RUN_KEYS = [
    "SR1_cooling_center", "SR2_misting_station", "SR3_welfare_check",
    "SR4_medical_prepositioning", "SR5_shade_structure",
]
LONG_RUN_KEYS = [
    "LR1_tree_planting", "LR2_cool_roof", "LR3_bgi", "LR4_cool_pavement",
    "LR5_green_corridor", "LR6_green_roof", "LR7_cool_morphology", "LR8_blue_infrastructure",
]
INTERVENTION_CODES = {
    "none": 0,
    "SR1": 1, "SR2": 2, "SR3": 3, "SR4": 4, "SR5": 5,
    "LR1": 6, "LR2": 7, "LR3": 8, "LR4": 9, "LR5": 10,
    "LR6": 11, "LR7": 12, "LR8": 13,
}
LONG_OBJECTIVES = [
    "f1_mortality_fraction", "f2_cost_fraction", "f3_equity_gini",
    "f4_cobenefit_neg_efficiency", "f5_scenario_robustness",
]
SHORT_OBJECTIVES = ["f1_coverage_gap", "f2_cost_fraction", "f3_inequity_gini"]
SEEDS = [42, 123, 456, 789, 1011]

# --- scenarios ---------------------------------------------------------------
SCENARIOS = [  # (name, warming, population factor, event days, description)
    ("A", 0.0, 1.0, 3.0, "Baseline Current"),
    ("B", 0.0, 1.15, 3.5, "Demographic Stress 2035"),
    ("C", 1.5, 1.15, 4.0, "Climate Stress 2035 SSP2-4.5"),
    ("D", 2.9, 1.265, 5.5, "Combined Stress 2050 SSP5-8.5"),
]
FALLBACK_DELTAS = {("ssp245", 2035): 1.5, ("ssp245", 2050): 2.0, ("ssp585", 2050): 2.9, ("ssp585", 2035): 2.1}
FALLBACK_DELTA = 1.5
DELTA_BAND = (0.5, 0.8)

# --- places ------------------------------------------------------------------
ISO3_BOXES = [  # (lat min, lat max, lon min, lon max, iso3); first match wins
    (6.0, 35.0, 68.0, 87.0, "IND"),
    (20.0, 27.0, 88.0, 92.0, "BGD"),
    (24.0, 37.0, 62.0, 77.0, "PAK"),
    (-5.0, 15.0, -18.0, 52.0, "NGA"),
    (36.0, 42.0, 28.0, 45.0, "TUR"),
    (10.0, 24.0, 36.0, 44.0, "ETH"),
    (20.0, 40.0, 100.0, 125.0, "PHL"),
    (-8.0, 6.0, 102.0, 120.0, "IDN"),
]

# --- population bands --------------------------------------------------------
CHILD_AGES = [0, 1]
ELDERLY_FROM_AGE = 60

# --- night-light downscaling -------------------------------------------------
DOWNSCALE_ZOOM = 4.5
KRIGING_NEIGHBORS = 20
KRIGING_SUB_PIXELS = 5
VARIOGRAM_MAX_LAG = 64.0  # coarse pixels
VARIOGRAM_BINS = 19
RF_TREES = [20, 50, 100]
RF_MIN_LEAF = 5
RF_TEST_FRACTION = 0.2
