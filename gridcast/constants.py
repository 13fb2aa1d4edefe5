"""Fixed values the results depend on."""

# --- fixed values: model constants -------------------------------------------
PYTHAGOREAN_EXPONENT = 2.37
TEAM_PSEUDOGAMES = 4
LEAGUE_PSEUDOGAMES = 8
PLAYER_PSEUDOGAMES = 4
HOME_FIELD_LOGIT = 0.25
HOME_FIELD_MARGIN_POINTS = 2.4483707813252598
POINTS_PER_TURNOVER_MARGIN = 1.281207368865855
PRIOR_CARRYOVER_FOR = 0.3331739443424684
PRIOR_CARRYOVER_AGAINST = 0.25624831456214603
PROBABILITY_FLOOR = 1e-6
LOG_LOSS_FLOOR = 1e-12
RATE_FLOOR = 1e-3
TIE_PAYOUT = 0.5
TIE_WIN_VALUE = 0.5
CONFIDENCE_BAND_Z = 1.0

# --- fixed values: cutoffs, windows and default sizes ------------------------
FORECAST_LEAD_HOURS = 24
CORROBORATION_HOURS = 2
MAX_CONFIRMED_AGE_HOURS = 24
MINIMUM_STARTER_GAMES = 3
BOOTSTRAP_RESAMPLES = 1000
IMPACT_RESAMPLES = 500
SEASON_TRIALS = 2000
SEED = 20260824
HOLDOUT_FRACTION = 0.6
CUMULATIVE_WEEKS = (1, 2, 4, 8, 17)

# --- fixed values: calibration acceptance rules ------------------------------
MINIMUM_CALIBRATION_SAMPLES = 50
MAX_CALIBRATION_GAP = 0.25
MINIMUM_GAP_BIN_COUNT = 5
PLATT_L2 = 1e-3

# --- fixed values: season shape and playoff places ---------------------------
EXPECTED_SEASON_GAMES = 272
EXPECTED_SEASON_TEAMS = 32
WILDCARDS_PER_CONFERENCE = 3

# --- fixed values: version and reason labels ---------------------------------
SCHEMA_VERSION = "1.0.0"
MODEL_VERSION = "pythagorean-v1"
UNCALIBRATED = "uncalibrated-v1"
PLATT = "platt-v1"
NO_HISTORY = "InsufficientHistoryError"
BAD_SCORING = "InvalidScoringInputError"
NO_REPLACEMENT = "MissingReplacementError"

# --- fixed values: words that may not appear in stored URLs or provider keys -
SENSITIVE_WORDS = (
    "api_key", "apikey", "secret", "private_key", "token", "password", "account_id",
)

# --- fixed values: production weights per stat category and label ------------
PRODUCTION_WEIGHTS = {
    "passing": {"YDS": 0.04, "TD": 4.0, "INT": -2.0},
    "rushing": {"YDS": 0.1, "TD": 6.0},
    "receiving": {"YDS": 0.1, "TD": 6.0},
    "defensive": {"SACKS": 2.0, "TD": 6.0, "TOT": 0.5},
    "kicking": {"FG": 3.0, "XP": 1.0},
}
OFFENSIVE_CATEGORIES = ("passing", "rushing", "receiving", "kicking")

# --- fixed values: availability report classes, most decisive first ----------
REPORT_CLASSES = (
    "gameday_inactive", "in_game_incident", "roster_status", "injury_status", "practice_participation",
)
OFFICIAL_CLASSES = ("gameday_inactive", "roster_status")

# --- fixed values: designation text to availability status, per class --------
STATUS_TEXT = {
    "injury_status": {
        "out": "out", "doubtful": "doubtful", "questionable": "limited", "probable": "limited",
    },
    "practice_participation": {
        "did not participate": "doubtful",
        "limited participation": "limited",
        "full participation": "available",
    },
    "gameday_inactive": {"inactive": "inactive", "active": "available"},
    "roster_status": {
        "injured reserve": "inactive",
        "physically unable to perform": "inactive",
        "non-football injury": "inactive",
        "reserve/injured": "inactive",
    },
}
AVAILABILITY_STATUSES = (
    "available", "limited", "doubtful", "out", "inactive", "left_game", "returned", "tentative", "unknown",
)
UNAVAILABLE_STATUSES = ("out", "inactive")
INJURY_REPORT_CONFIDENCE = 0.6

# --- fixed values: season phase codes in landed scoreboards ------------------
SEASON_TYPE_CODES = {1: "preseason", 2: "regular", 3: "postseason"}

# --- fixed values: conference and division of each team abbreviation ---------
DIVISIONS = {
    "BUF": ("AFC", "East"), "MIA": ("AFC", "East"), "NE": ("AFC", "East"), "NYJ": ("AFC", "East"),
    "BAL": ("AFC", "North"), "CIN": ("AFC", "North"), "CLE": ("AFC", "North"), "PIT": ("AFC", "North"),
    "HOU": ("AFC", "South"), "IND": ("AFC", "South"), "JAX": ("AFC", "South"), "TEN": ("AFC", "South"),
    "DEN": ("AFC", "West"), "KC": ("AFC", "West"), "LAC": ("AFC", "West"), "LV": ("AFC", "West"),
    "DAL": ("NFC", "East"), "NYG": ("NFC", "East"), "PHI": ("NFC", "East"), "WSH": ("NFC", "East"),
    "CHI": ("NFC", "North"), "DET": ("NFC", "North"), "GB": ("NFC", "North"), "MIN": ("NFC", "North"),
    "ATL": ("NFC", "South"), "CAR": ("NFC", "South"), "NO": ("NFC", "South"), "TB": ("NFC", "South"),
    "ARI": ("NFC", "West"), "LAR": ("NFC", "West"), "SF": ("NFC", "West"), "SEA": ("NFC", "West"),
}
