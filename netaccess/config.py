"""Fixed values of the accessibility model, in one place."""

# fixed values: thresholds and parameters of the published model
SNAP_DEG = 0.0045
MIN_ROAD_KM, MIN_SPEED_ROAD_KM = 0.1, 0.05
KM_PER_DEG = 111.0
BLOCK_PROBABILITY = 0.5
MAX_BLOCK = 0.99
EFFICIENCY_SAMPLE, DIAMETER_SAMPLE = 300, 150
PERCOLATION_STEPS, PERCOLATION_ALPHA, PERCOLATION_SAMPLE, PERCOLATION_EFFICIENCY_STEPS = 50, 0.6, 200, 51
SEVERE_INCREASE_PCT = 50.0
BORDER_BAND_DEG, BORDER_LINK_DEG, BORDER_SPEED = 0.5, 0.20, 40.0
PLACE_SNAP_DEG = 0.5
POP_CELL_DEG, URBAN_POP, RURAL_POP, RURAL_SAMPLE = 0.5, 50_000.0, 1_000.0, 3_000
NI_ALPHA, ACCESS_ALPHA = 2.0, 1.0
CV_MIN = 0.02
SNAP_MAX_KM = 50.0
ISOCHRONE_HOURS = (0.5, 1.0, 2.0, 4.0)
MATCH_DEG, TOP_K = 0.02, 500
IRI0, DT_YEARS, ADT, ADL, ADH, MGD, IRI_FLOOR = 6.0, 1.0 / 12.0, 50.0, 42.0, 8.0, 0.5, 12.0
ROUGHNESS_SPEED = ((6.0, 106.0), (8.0, 80.0), (10.0, 64.0), (12.0, 53.0), (14.0, 46.0), (16.0, 40.0), (18.0, 35.0), (20.0, 32.0))
MOISTURE_PERCENTILES = (0.75, 0.95)
PAVED_SPEEDS = (80.0, 65.0)
PAVED_PASS = (1.0, 0.8125)
SHARES = (0.01, 0.03, 0.05, 0.10)
SCORE_ALPHAS = (1.5, 2.0, 2.5)
PAVING_FRACTIONS = (0.0, 0.001, 0.005, 0.01, 0.02, 0.05, 0.1, 0.2, 0.5)
PAVING_LEVELS = (0.0, 0.001, 0.002, 0.005, 0.01, 0.02, 0.03, 0.05, 0.075, 0.1, 0.15, 0.2, 0.3, 0.4, 0.5)
PAVING_TRIALS, RECOVERY_LEVELS, RECOVERY_ALPHAS = 5, (0.0, 0.001, 0.002, 0.005, 0.01), (1.0, 2.0)
ISOLATION_SHARE, SEVERE_CV, EXTREME_CV, REACH_HOURS = 0.05, 0.5, 1.0, 1.0
SEED = 42
