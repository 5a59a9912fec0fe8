"""Thresholds, prices, name lists and message texts.

They are part of the reported results and must not be reworded.
"""

# --- vitals: (metric, operator, bound, status), first match wins -------------
VITALS_THRESHOLDS = [
    ("page_life_expectancy", "<", 100, "CRIT"),
    ("page_life_expectancy", "<", 300, "WARN"),
    ("memory_grants_pending", ">=", 5, "CRIT"),
    ("memory_grants_pending", ">", 0, "WARN"),
    ("blocked_sessions", ">=", 5, "CRIT"),
    ("blocked_sessions", ">", 0, "WARN"),
    ("queued_queries", ">", 0, "WARN"),
    ("load_errors_24h", ">", 0, "WARN"),
    ("suspect_pages", ">", 0, "CRIT"),
    ("cpu_pct", ">=", 95, "CRIT"),
    ("cpu_pct", ">=", 80, "WARN"),
    ("tempdb_version_store_gb", ">=", 150, "CRIT"),
    ("tempdb_version_store_gb", ">=", 50, "WARN"),
    ("max_vlf_count", ">=", 10000, "CRIT"),
    ("max_vlf_count", ">=", 1000, "WARN"),
]

# --- prices ------------------------------------------------------------------
EXTERNAL_SCAN_USD_PER_TB = 5.0
STORAGE_USD_PER_GB_MONTH = 0.024

# --- backup rules ------------------------------------------------------------
LOGGED_RECOVERY_MODELS = ["FULL", "BULK_LOGGED"]
SYSTEM_DATABASES = ["master", "model", "msdb"]
NEVER_CHECKED = "1900-01-01 00:00:00"

# --- names that normalise on upsert -------------------------------------------
PLATFORMS = ["MSSQL", "Redshift"]
AUTH_TYPES = ["windows", "sql"]
TIERS = ["Tier1", "Tier2", "Tier3"]
WHOLE_INSTANCE = "(instance)"

# --- estate grid ----------------------------------------------------------------
DOMAINS = ["Backup", "Disk", "Jobs", "HA", "Perf", "Data"]

# --- fixed values: wait types that only mean "idle" --------------------------------------------
BENIGN_WAITS = [
    "CLR_SEMAPHORE",
    "LAZYWRITER_SLEEP",
    "RESOURCE_QUEUE",
    "SLEEP_TASK",
    "SLEEP_SYSTEMTASK",
    "SQLTRACE_BUFFER_FLUSH",
    "WAITFOR",
    "LOGMGR_QUEUE",
    "CHECKPOINT_QUEUE",
    "REQUEST_FOR_DEADLOCK_SEARCH",
    "XE_TIMER_EVENT",
    "BROKER_TO_FLUSH",
    "BROKER_TASK_STOP",
    "CLR_MANUAL_EVENT",
    "CLR_AUTO_EVENT",
    "DISPATCHER_QUEUE_SEMAPHORE",
    "FT_IFTS_SCHEDULER_IDLE_WAIT",
    "XE_DISPATCHER_WAIT",
    "XE_DISPATCHER_JOIN",
    "BROKER_EVENTHANDLER",
    "TRACEWRITE",
    "FT_IFTSHC_MUTEX",
    "SQLTRACE_INCREMENTAL_FLUSH_SLEEP",
    "BROKER_RECEIVE_WAITFOR",
    "ONDEMAND_TASK_QUEUE",
    "DBMIRROR_EVENTS_QUEUE",
    "DBMIRRORING_CMD",
    "BROKER_TRANSMITTER",
    "SQLTRACE_WAIT_ENTRIES",
    "SLEEP_BPOOL_FLUSH",
    "SQLTRACE_LOCK",
    "DIRTY_PAGE_POLL",
    "HADR_FILESTREAM_IOMGR_IOCOMPLETION",
    "SP_SERVER_DIAGNOSTICS_SLEEP",
    "QDS_PERSIST_TASK_MAIN_LOOP_SLEEP",
    "QDS_CLEANUP_STALE_QUERIES_TASK_MAIN_LOOP_SLEEP",
    "WAIT_XTP_HOST_WAIT",
]

# --- lock-wait patterns: texts with {column} placeholders ---------------------------
DDL_PREFIXES = ["ALTER", "DROP", "TRUNCATE", "CREATE"]

FINDING_TITLE = "Lock wait {WaitMinutes} min on {Relation} (PID {WaiterPid} blocked by PID {BlockerPid})"
FINDING_SYMPTOM = (
    "PID {WaiterPid} ({WaiterUser?}) has waited {WaitMinutes} min for a lock on {Relation}, "
    "held by PID {BlockerPid} ({BlockerUser?})."
)
FINDING_EVIDENCE = (
    "waiter_pid={WaiterPid} blocker_pid={BlockerPid} lock_mode={BlockerLockMode?} wait_min={WaitMinutes} "
    "idle_in_txn={BlockerIdleInTxn} conflicts_24h={Conflicts}"
)

ROOT_CAUSE = {
    "IDLE_TXN": "Blocker PID {BlockerPid} holds the lock but has no running query - it is idle inside an open "
    "transaction. A session or app issued BEGIN and never COMMIT/ROLLBACK.",
    "DDL": "A DDL statement (ALTER/DROP/TRUNCATE/CREATE) is queued behind a longer read/write on the same table; "
    "DDL needs an exclusive lock.",
    "CONFLICT": "{ConflictCount24h} serialization-isolation aborts on this table in the last 24h - concurrent "
    "transactions are writing overlapping rows and serializing on each other.",
    "VACUUM": "A VACUUM / maintenance operation holds a lock that conflicts with writers on the table.",
    "GENERIC": "A long-running transaction is holding a conflicting lock; the waiter cannot proceed until it commits.",
}
RECOMMENDATION = {
    "IDLE_TXN": "Confirm the owner of PID {BlockerPid} is safe to release, then: "
    "SELECT pg_terminate_backend({BlockerPid});",
    "DDL": "Let the current statement finish, or reschedule the DDL. If the DDL is urgent, cancel the blocker: "
    "SELECT pg_terminate_backend({BlockerPid});",
    "CONFLICT": "Retry the aborted transactions, and serialize the competing writers (one writer, or load a staging "
    "table then a single MERGE).",
    "VACUUM": "Wait for VACUUM to complete; avoid killing it mid-run. If it must yield, cancel it and reschedule "
    "off-peak.",
    "GENERIC": "Identify the blocker and, once confirmed safe, cancel it: SELECT pg_terminate_backend({BlockerPid});",
}
PREVENTION = {
    "IDLE_TXN": "Set an idle-session / statement timeout; make the app COMMIT or ROLLBACK deterministically; do not "
    "leave BEGIN open in ad-hoc SQL tools; alert on idle-in-transaction sessions.",
    "DDL": "Run DDL in a maintenance window, keep read/write transactions short, and use late-binding views to swap "
    "tables without holding long locks.",
    "CONFLICT": "Stagger ETL so writers to the same table do not overlap; funnel writes through a staging table + "
    "single MERGE; keep transactions small.",
    "VACUUM": "Schedule VACUUM off-peak, enable auto-vacuum, and vacuum narrower table ranges to shorten lock windows.",
    "GENERIC": "Keep transactions short and commit promptly; monitor for transactions open longer than your SLA.",
}
