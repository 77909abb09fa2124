"""Windows and thresholds shared by the queries and their SQL. Months of the order tables play the part of days."""

FIRST_DAY = "0001-01-01"
OWNED_END = "1998-12-01"
TARGET_START, TARGET_END = "1999-01-01", "1999-12-01"
TRAIN_START, TRAIN_END = "2000-01-01", "2000-07-01"
TEST_DAY = "2000-08-01"

MIN_USERS = 5
MIN_ROWS = 20
LEAST_USERS = 40
COARSE = ["display_marketing_name", "os_version_id", "market_id"]

# Windows of twelve months that move on by one: start and end of each.
SLIDING = (("1997-11-01", "1998-10-01"), ("1997-12-01", "1998-11-01"), ("1998-01-01", "1998-12-01"))
LATE_DAY = "2000-05-01"
