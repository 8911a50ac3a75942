"""Parameters of the analytics. Fixed values are stated together and in their natural order."""

# --- fixed values: window table of the published study (label, start, end, regime) ---
SNAPSHOTS = [
    ("Oct 1987 Black Monday", "1987-07-19", "1988-01-19", "crisis"),
    ("1990-91 Recession", "1990-05-23", "1990-11-23", "stress"),
    ("1993 Calm", "1993-01-01", "1993-12-31", "baseline"),
    ("Dec 1994 Tequila", "1994-09-20", "1995-03-20", "stress"),
    ("Oct 1997 Asian Crisis", "1997-07-27", "1998-01-27", "crisis"),
    ("Oct 1998 LTCM", "1998-07-08", "1999-01-08", "crisis"),
    ("Apr 2000 Dot-com", "2000-01-14", "2000-07-14", "crisis"),
    ("Sep 2001 9/11", "2001-06-20", "2001-12-20", "crisis"),
    ("Jul 2002 WorldCom", "2002-04-23", "2002-10-23", "stress"),
    ("2005 Calm", "2005-01-01", "2005-12-31", "baseline"),
    ("2007 Subprime Buildup", "2007-08-12", "2008-02-12", "stress"),
    ("Oct 2008 GFC", "2008-08-20", "2009-02-20", "crisis"),
    ("Mar 2009 Recovery", "2009-04-01", "2009-09-30", "recovery"),
    ("2013 Calm", "2013-01-01", "2013-12-31", "baseline"),
    ("2017 Calm", "2017-01-01", "2017-12-31", "baseline"),
    ("Q4 2018 VolShock", "2018-09-24", "2019-03-24", "stress"),
    ("Mar 2020 COVID", "2019-12-16", "2020-06-16", "crisis"),
    ("Jun 2020 Stable", "2020-06-17", "2020-12-17", "recovery"),
    ("2022 Rate Hikes", "2022-03-07", "2022-09-07", "stress"),
    ("2024 Contemporary", "2024-01-01", "2024-12-31", "baseline"),
]

# --- fixed values: label overrides by permanent id ---
TICKER_OVERRIDES = {
    80599: "LEH", 68304: "BSC", 52919: "MER", 51043: "FNM",
    75789: "FRE", 81593: "WAMU", 66800: "AIG", 25785: "F",
}

# --- fixed values: industry code bands (inclusive) to sector ---
SECTOR_BANDS = [
    (1000, 1499, "Materials"),
    (1500, 1799, "Industrials"),
    (2000, 2199, "Consumer Staples"),
    (2200, 2399, "Consumer Discretionary"),
    (2400, 2599, "Industrials"),
    (2600, 2699, "Materials"),
    (2700, 2799, "Communication Services"),
    (2800, 2899, "Materials"),
    (2900, 2999, "Energy"),
    (3000, 3199, "Consumer Discretionary"),
    (3200, 3299, "Materials"),
    (3300, 3499, "Industrials"),
    (3500, 3599, "Industrials"),
    (3600, 3699, "Information Technology"),
    (3700, 3799, "Industrials"),
    (3800, 3899, "Health Care"),
    (3900, 3999, "Consumer Discretionary"),
    (4000, 4799, "Industrials"),
    (4800, 4899, "Communication Services"),
    (4900, 4999, "Utilities"),
    (5000, 5199, "Consumer Staples"),
    (5200, 5999, "Consumer Discretionary"),
    (6000, 6499, "Financials"),
    (6500, 6599, "Real Estate"),
    (6700, 6799, "Financials"),
    (7000, 7299, "Consumer Discretionary"),
    (7300, 7399, "Information Technology"),
    (7400, 7799, "Industrials"),
    (7800, 7999, "Communication Services"),
    (8000, 8099, "Health Care"),
    (8100, 8999, "Industrials"),
]

# --- fixed values: step functions of n/p (ratio strictly below edge -> value, else last) ---
GAMMA_STEPS = [(3.0, 0.0), (5.0, 0.25)]
GAMMA_ELSE = 0.5
DELTA_STEPS = [(0.2, 0.55), (0.3, 0.45), (0.5, 0.35), (1.0, 0.15), (2.0, 0.05)]
DELTA_ELSE = 0.005

# --- fixed values: solver, test and index parameters ---
LAMBDA_RANGE, N_LAMBDAS = (0.05, 1.0), 25
EARLY_STOP_PATIENCE = 8
EDGE_EPS = 1e-10
ALPHA, TAU, LAG, GRANGER_LAG, GRANGER_FLOOR, N_CONTROLS = 0.05, 1.5, 1, 1, 0.5, 5
DAMPING = 0.85
N_ER_SIMS, N_REWIRES, N_ER_MATCHED = 200, 100, 50
NSI_WEIGHTS = {"network_sparsity": 0.25, "hhi_top10": 0.20, "mean_corr": 0.35, "motif_shift": 0.20}
ROLLING_WEIGHTS = {"one_minus_q": 0.35, "mean_corr": 0.35, "density": 0.30}
ROLLING_WINDOW, ROLLING_STEP, ROLLING_LAMBDA, ROLLING_MIN_ASSETS = 252, 21, 0.15, 20
MIN_COVERAGE, MIN_ROWS, MIN_ASSETS, STD_FLOOR, CLIP = 0.8, 30, 10, 1e-8, 10.0
ADCC_SUBSET, ADCC_MIN_ROWS = 100, 252
ADCC_BOUNDS = [(1e-6, 0.3), (0.5, 0.999), (1e-6, 0.3)]
ADCC_STARTS = [
    (0.02, 0.95, 0.01), (0.01, 0.97, 0.01), (0.10, 0.85, 0.02),
    (0.04, 0.94, 0.01), (0.05, 0.90, 0.05),
]
ADCC_SLACK, ADCC_SEED = 1e-3, 2026
SPECTRAL_TRIGGER, SPECTRAL_TARGET = 1e-6, 1e-4
ALPHA_GRID, TAU_GRID, LAG_GRID, FLOOR_GRID = (0.05, 0.10), (1.2, 1.5, 2.0), (1, 2), (0.3, 0.5, 0.7)
CUTOFFS = {"SW": "2024-07-15", "AMCR": "2019-06-11"}
SELECTION_KINDS = ("coverage", "adv", "bottom_adv", "bottom_coverage",
                   "decile1", "decile2", "decile3", "decile4", "decile5")
BACKTEST_LAGS = [5, 10, 15, 21, 42, 63]
PANEL_SIZES = [50, 100, 150, 200, 250, 300, 350, 400, 450, 500]
