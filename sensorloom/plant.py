"""Plant defaults. Every operator takes these as arguments; nothing reads them implicitly."""

from __future__ import annotations

import math

# ---------------------------------------------------------------------------
# Fixed values (names, dates, rates and limits that results depend on)
# ---------------------------------------------------------------------------
NH3 = "nh3_roll_mean_15min"
H2S = "h2s_roll_max_15min"
RAW_NH3 = "nh3_nh3_ppm"
RAW_H2S = "h2s_h2s_ppm"
TEMP_NH3 = "nh3_temperature_°f"
TEMP_H2S = "h2s_temperature_°f"

WEST = "west_sludge_out_gpm"
EAST = "east_sludge_out_gpm"
DIGESTER = "digesters_sludge_out_flow"
COMBINED = "east_sludge_out_gpm_combined"
FLOWS = [WEST, EAST, DIGESTER]

STATES = {"Ferric": "ferric_available", "HCl": "hcl_available"}
SIGNALS = {"NH3": NH3, "H2S": H2S}

MISSPELT = {"eest_sludge_out_gpm": EAST}
BINARY_SUFFIX = "_available"
BINARY_NAMES = ["sensor_valid", "truck_activity_proxy"]
CARRIED_WORDS = ["sludge", "flow", "pump"]

# name, default, then [start, end) windows with the value inside; None = open end
CALENDAR = {
    "hcl_available": (1, [("2025-08-27 00:00", "2025-10-02 14:30", 0), ("2025-11-06 00:00", None, 0)]),
    "ferric_available": (1, [("2025-09-09 08:00", "2025-09-17 12:00", 0)]),
    "sensor_valid": (1, [("2025-10-08 08:00", None, 0)]),
    "ferric_reduced_rate": (0, [("2026-01-07 00:00", None, 1)]),
}
PHASES = [
    ("Pre-shutdown", "2025-08-27"),
    ("Chemical OFF (HCl & partial Ferric)", "2025-10-02"),
    ("Post-resumption", None),
]
FERRIC_CUT = "2026-01-07 00:00"

LB_PER_MGAL_MGL = 8.34
SOLIDS_FACTOR = 1.38
VOLATILE_FRACTION = 0.66
LBS_PER_GAL = LB_PER_MGAL_MGL * SOLIDS_FACTOR * VOLATILE_FRACTION
FERRIC_DEMAND_DIVISOR = 24.3
PER_LB_EPSILON = 1e-9

FERRIC_SOLUTION_LBS, FERRIC_STRENGTH, FERRIC_GRAVITY = 583.0, 0.379, 1.404
HCL_SOLUTION_LBS, HCL_STRENGTH, HCL_GRAVITY = 6230.0, 0.32, 1.16

PH = 7.0
# species, mol/L, charge
IONS = [
    ("ca_2+", 17.6, 2),
    ("cl_-", 0.019, -1),
    ("cu_2+", 0.005, 2),
    ("cu_1+", 0.005, 1),
    ("fe_2+", 4.932e-4, 2),
    ("fe_3+", 4.932e-40, 3),
    ("k_1+", 0.05, 1),
    ("mg_2+", 0.27, 2),
    ("nh4_1+", 0.038, 1),
]

GAP_LIMIT_MIN = 10
LAGS_MIN = [5, 15, 30, 60]
ROLLS_MIN = [5, 15, 30, 60]
BASELINE_WINDOW = (-2880, -720)
POST_WINDOW = (720, 5760)
STUDY_MIN = 4320
WINDOW_MIN = 2880
PRETREND_WINDOW = (-1440, -60)
PRETREND_TOLERANCE = 0.1

HORIZONS_MIN = [15, 60, 180]
LIMITS = {"nh3": 5.0, "h2s": 1.0}
TRAIN_SHARE, VALIDATION_SHARE = 0.70, 0.85
LEAK_PATTERNS = ["_t_plus_", "_delta_", "_exceeds_", "target_ready_", "model_row_valid_"]
LEAK_NAMES = ["split"]
BOOSTING = {"rate": 0.05, "rounds": 300, "depth": 6, "leaves": 31, "min_leaf": 50, "l2": 0.1, "bins": 255}

# columns that stored minutes have once flows are filled and loads are made
ENRICHED = ["total_gpm", "lbs_per_min", "transferred_lbs_vol"]

LOW_FLOW_MGD = 0.05

PREAMBLE_LINES = 8
HEADER_SCAN_LINES = 12
MARKER_SCAN_LINES = 15
FLOW_HEADER_TERMS = [
    "west sludge out",
    "east sludge out",
    "eest sludge out",
    "digesters sludge out flow",
    "gbt sludge feed pump",
]
FLOW_EXPORT_COLUMNS = [
    "Time",
    "West Sludge Out (GPM)",
    "West Sludge Flow Today (Gal)",
    "East Sludge Out (GPM)",
    "East Sludge Flow Today (Gal)",
    "West Sludge Tank Level (FT)",
    "GBT Sludge Feed Pump 1 (GPM)",
    "GBT Sludge Feed Pump 2 (GPM)",
]
OPTIONAL_TABLES = {
    "Struvite Observations": (
        [["timestamp", "date", "sample_date"], ["location", "sample_location", "asset"]],
        ["severity", "coupon_result", "notes"],
    ),
    "Chemistry Lab Results": (
        [["timestamp", "date", "sample_date"], ["pH", "alkalinity", "mg", "nh4", "po4"]],
        ["sample_location", "notes"],
    ),
}
OPTIONAL_DATE_COLUMNS = ["timestamp", "date", "sample_time", "sample_date"]
EVENT_METRICS = ["baseline", "post", "delta", "percent_change", "time_to_min", "persistence", "post_iqr"]

assert math.isclose(LBS_PER_GAL, 7.596072)
