"""Every provisional limit in one place (fixed values)."""

ERROR_RATIO_PERCENT = 30
CASCADE_DEPTH = 3
CANDIDATES = 32
SAMPLE = 512
OVERSIZE_BYTES = 2 * 1024 * 1024
MARKER_BYTES = 2048
SHEBANG_BYTES = 256
HISTORY = 400
CACHE_BYTES = 2 * 1024**3
PATH_PRODUCT = 10_000
DEPTH = 3
NODES = 500
BYTES_PER_TOKEN = 4
QUARANTINE_BYTES = 64 * 1024 * 1024
STRAY_SECONDS = 3600
WATCH_PRODUCT = 1_000_000
TOUCH_CAP = 10
NEAR_CAP = 10
PLAN_PATH_CAP = 32
REVIEWABLE = 3
