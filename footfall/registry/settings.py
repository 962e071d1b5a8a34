"""Parameters shared by the registered queries and their SQL."""

from dataclasses import replace

from footfall.params import TaskParams

START, END = "2024-01-05", "2024-01-25"
RANGE = TaskParams(start_date=START, end_date=END)
FLOW = (1, 2, 3, 4, 5)
AGES = (25, 55)
KEYWORDS = ("kw1", "kw2", "kw3")
PROFESSIONALS = ("BUILDING", "MACHINERY", "HOUSEHOLD")
CITIES = tuple(f"NATION_{i}" for i in range(0, 25, 2))
CATEGORIES = tuple(range(0, 100, 3))
SEX = "male"
ALL_FILTERS = TaskParams(
    start_age=AGES[0],
    end_age=AGES[1],
    professionals=PROFESSIONALS + ("AUTOMOBILE",),
    sex=SEX,
    keywords=KEYWORDS,
)
SAMPLE_SIZE = 2000
SEED = "7"
SALT_BUCKETS = 10
AREA_LEVELS = {"A": ("ASIA", "EUROPE"), "B": ("AMERICA", "AFRICA")}
CURRENT_PERIOD = ("2024-01-16", "2024-01-30")
PREVIOUS_PERIOD = ("2024-01-01", "2024-01-15")
REGISTERED = ("2024-01-01", "2024-01-20")
BLACKLIST_THRESHOLD = 2
REPLAY_DAYS = 5
FIRST_DAY, WINDOW_BATCHES = "2024-01-01", 7
HOT_SHARE = 0.006
BUCKETS = 8
LOOKED_UP = 12
TASK = replace(ALL_FILTERS, start_date=START, end_date=END)
