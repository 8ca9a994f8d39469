"""Fixed parameters of the registered queries (explicit instead of hidden clocks)."""

# ---- fixed values ------------------------------------------------------------------------
SINCE = "2024-01-01 00:00:00"          # incremental mark for the item runs (UTC)
AS_OF = "2024-02-02 00:00:00"          # "now" of the runs (UTC)
SOURCE_LIST = "src1, src3,,src5 "      # a configured source list, with blanks to clean
LANGUAGE = "en"
RETENTION_DAYS = 30
FRESHNESS_WARN_HOURS = 24
FRESHNESS_ERROR_HOURS = 48
RATE_WINDOW = "5 minutes"
RATE_STEP = "1 minute"
HIST_QUANTILE = 0.95
ACCURACY_GATE = 0.82
LABEL_SCAN_LIMIT = 25
# --------------------------------------------------------------------------------------------
KEYWORDS = "tionha OR Is and OR der die"   # a keyword query whose phrases occur in the test prose
RETENTION_AS_OF = "2024-03-02 12:00:00"
MARK_NAME = "news_pipeline_last_published_at"
GRAPH_AS_OF = "2024-02-03 00:00:00"
EDGE_SEED_TIME = "2024-01-15 00:00:00"
LOOKUP_NAME = "small bolt"
LINEAGE_DEPLOYMENT = "dep_1"
SEARCH_TERMS = ("der", "die", "und", "river", "the")
COUNTER_WINDOW = "1 hour"
DASHBOARD_NOW = "2024-01-30 12:00:00"
DASHBOARD_HOURS = 6
FRESHNESS_AS_OF = "2024-02-03 12:00:00"
PAGE_SINCE = "2024-01-01 05:00:00"     # mark of the paged runs
PAGE_ITEMS = 30                        # page size of the paged runs
RUN_GAP_SECONDS = 120
RANKED_TERMS = ("tion", "ond", "th", "der", "river")
RANKED_K = 50
TITLE_WEIGHT = 2.0
