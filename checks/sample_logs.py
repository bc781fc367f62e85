"""Log lines derived from the ``events`` table.

The test tables hold no log lines, so one line is written per event, with the
event's own time, user and id in it: ``header level message``.  Header form,
level word and message are picked from the lists below by event id.  Both the
Spark expression and the equivalent SQL text are built from the same lists.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

LEVELS = (
    "ERROR", "INFO", "WARN", "FATAL", "DEBUG", "CRITICAL", "error", "NOTICE",
    "EMERG", "WARNING", "ALERT", "TRACE", "CRIT", "ERR", "VERBOSE", "",
)

# {n} is the event id, {u} the user id, {m} a number from 0 to 249.
MESSAGES = (
    'ECONNREFUSED 10.0.0.{m}:5432 could not connect to database',
    'ECONNREFUSED 10.0.1.{m}:3306 in production while opening pool {n}',
    'query timed out after {m}s, lock wait timeout exceeded (Error Code: 1205)',
    'FATAL: password authentication failed for user "svc_{u}"',
    'Login failed for user=app{u} on 10.1.{m}.7 port=1433',
    'FATAL: too many connections, connection pool exhausted (max_connections={m})',
    'replication lag on replica 3 is {m} seconds behind primary',
    'Seconds_Behind_Master: {n}',
    'connect ETIMEDOUT 172.16.{m}.9:443',
    'socket timeout talking to https://api.example.com/v1/users/{u}?page={m}',
    'getaddrinfo ENOTFOUND db-{u}.internal.example.com',
    'DNS lookup error: NXDOMAIN for host{m}.example.org',
    'read ECONNRESET repeated {m} times, connection reset by peer',
    'write EPIPE broken pipe on upload {n}',
    'SSL handshake error: certificate has expired for example{m}.com',
    'self-signed certificate in chain: DEPTH_ZERO_SELF_SIGNED_CERT',
    'listen EADDRINUSE: address already in use :::{u}',
    'port 80{m} already bound by pid={n}',
    'login failed for admin from 192.168.4.{m}',
    'multiple failed login attempts, invalid credentials for username: bob{u}',
    'JWT token expired for session {n}',
    'TokenExpiredError: service-to-service token expired',
    'EACCES: permission denied, open /var/lib/app/{u}/state.db',
    'HTTP/1.1" 403 Forbidden GET /admin/users/{u}',
    'brute force suspected: account locked after {m} failed attempts',
    'too many failed login attempts from 203.0.113.{m}',
    'JavaScript heap out of memory, heap size {n} exceeded',
    'OOM killer invoked, cannot allocate memory for pid {n}',
    'ENOSPC: no space left on device, write /data/part-{m}.tmp',
    'disk space on /mnt/vol{m} critical, filesystem 100% full',
    'cpu usage high: 9{m}% sustained on node {u}',
    'load average critical, cpu throttl detected',
    'segmentation fault (core dumped) SIGSEGV in worker {m}',
    'unhandled exception, process {n} crashed: fatal error',
    'ENOENT: no such file or directory, open config/settings.yml',
    'java.io.FileNotFoundException: C:\\data\\in\\file{m}.csv (file not found)',
    'rate limit exceeded for payment api, status=429 too many requests',
    'quota for tenant {u} exceeded, retry in {m} s',
    '504 Gateway Timeout: upstream timed out on POST /api/v2/orders/{n}',
    'Request timed out after 30000ms (code=E{m})',
    '400 Bad Request: validation error in field name, malformed JSON body',
    'HTTP 500 Internal Server Error while serving PUT /cart/{u}',
    'unexpected error, frequent 500 responses from svc-{m}',
    '503 Service Unavailable, server is down for maintenance mode',
    'CORS policy blocked request, preflight failed for https://shop{m}.example.com',
    'environment variable DATABASE_URL missing for worker {n}',
    'missing required config: region, config not found in /etc/app/{u}.toml',
    'port mismatch: expected 8080 but got {m}',
    'Error: cannot find module express, MODULE_NOT_FOUND',
    'ImportError: No module named requests{m}',
    'Back-off restarting failed container, CrashLoopBackOff pod web-{u}',
    'Failed to pull image registry.example.com/app:{m} ErrImagePull',
    'container web-{u} OOMKilled, exit code 137, memory cgroup out of memory',
    'node ip-10-2-{m}-4 is NotReady, kubelet stopped posting node status',
    'Liveness probe failed: HTTP probe failed with statuscode: 503',
    'pod cart-{u} evicted, DiskPressure on node, eviction threshold met',
    'User system:serviceaccount:ns{m} cannot list pods: is forbidden by RBAC',
    'Cannot connect to the Docker daemon. Is the docker daemon running?',
    'docker build failed: failed to compute cache key at step {m}',
    'container job-{n} exited with code 2',
    'network app_{m} not found, failed to join network',
    'bind mount denied for volume data{m}: permission',
    'Task timed out after {m}.00 seconds in Lambda fn{u}, timeout',
    'RequestId: r-{n} Process exited before completing request, Runtime.ExitError',
    'AccessDenied on s3 bucket logs-{m}: NoSuchKey',
    'ThrottlingException: Rate exceeded, repeated for table{u}',
    'ExpiredToken: credentials expired while calling AssumeRole, denied',
    'RabbitMQ connection closed, lost connection to broker {m}',
    'Kafka consumer lag very high: backlog {n} on offset topic',
    'message rejected, sent to dead letter queue DLQ after max retries exceeded',
    'publish to topic orders failed: channel closed, message {n}',
    'Redis error: NOAUTH Authentication required on cache {m}',
    'cache miss rate spike, cache hit ratio dropped to {m}',
    'SMTP error 550 mailbox rejected, email delivery failed for password reset',
    'logrotate error: log file too large {n}',
    '502 Bad Gateway: upstream prematurely closed connection, nginx proxy',
    'deadlock detected, deadlock victim was transaction {n} (Error 1213)',
    'RangeError: Maximum call stack size exceeded, stack overflow in recursion',
    'UnhandledPromiseRejection: unhandled promise rejection will crash worker {m}',
    'TypeError: Cannot read properties of undefined, is not a function',
    'possible EventEmitter memory leak detected, MaxListenersExceeded {m}',
    'No \'Access-Control-Allow-Origin\' header, OPTIONS blocked 403',
    'invalid date in billing schedule, timezone error NaN timestamp',
    'request {n} served in {m} ms and/or cached',
    'user u{u} signed in from 10.9.8.{m}:5{m}',
    'retry at 10:30:00 later, outage reported',
    'heartbeat ok',
    'exploit scan found nothing in {m} files, recurring job {n}',
    'GET /health 200 OK',
)
_HEADERS = 6
_CALLER_SOURCES = 5  # one line in five carries a caller-given source


def sample_logs(events: DataFrame, *kept: str) -> DataFrame:
    """``log_id, seq, incident_id, raw_log, source`` and ``kept`` for every event."""
    eid, uid, ts = F.col("event_id"), F.col("user_id"), F.col("ts")
    small = (eid + uid) % 250

    def pick(values: tuple[str, ...], by: Column) -> Column:
        return F.element_at(F.array(*[F.lit(v) for v in values]), (by + 1).cast("int"))

    message = pick(MESSAGES, eid % len(MESSAGES))
    for mark, value in (("{n}", eid), ("{u}", uid), ("{m}", small)):
        message = F.replace(message, F.lit(mark), value.cast("string"))
    level = pick(LEVELS, F.floor(eid / _HEADERS) % len(LEVELS))

    def at(fmt: str) -> Column:
        return F.date_format(ts, fmt)

    form = eid % _HEADERS
    svc = (uid % 10).cast("string")
    raw = (
        F.when(form == 0, F.concat(at("yyyy-MM-dd'T'HH:mm:ss'Z'"), F.lit(" "), level, F.lit(" [svc"), svc, F.lit("] "), message))
        .when(form == 1, F.concat(at("MMM d HH:mm:ss"), F.lit(" host"), svc, F.lit(" svc["), uid.cast("string"), F.lit("]: "), level, F.lit(" "), message))
        .when(form == 2, F.concat(at("yyyy-MM-dd HH:mm:ss"), F.lit(" - app"), svc, F.lit(".service "), level, F.lit(" "), message))
        .when(form == 3, F.concat((eid + 1700000000).cast("string"), F.lit(" "), level, F.lit(" (job-"), svc, F.lit(") "), message))
        .when(form == 4, F.concat(F.lit("10.0."), svc, F.lit(".1 - - "), at("dd/MMM/yyyy:HH:mm:ss"), F.lit(" +0000 "), level, F.lit(" "), message))
        .otherwise(F.concat(F.lit("  worker-"), svc, F.lit(" | "), level, F.lit(": "), message, F.lit(" "))))
    return events.select(
        eid.alias("log_id"), eid.alias("seq"),
        F.concat(F.lit("INC-"), uid.cast("string"), F.lit("-"), at("dd")).alias("incident_id"),
        raw.alias("raw_log"),
        F.when(eid % _CALLER_SOURCES == 0, F.concat(F.lit("caller-"), svc)).alias("source"),
        *kept)


def _sql_list(values: tuple[str, ...]) -> str:
    return "[" + ", ".join("'" + v.replace("'", "''") + "'" for v in values) + "]"


def sample_logs_sql() -> str:
    """The same rows as a DuckDB select over ``events``."""
    message = f"({_sql_list(MESSAGES)})[event_id % {len(MESSAGES)} + 1]"
    for mark, value in (("{n}", "event_id"), ("{u}", "user_id"), ("{m}", "(event_id + user_id) % 250")):
        message = f"replace({message}, '{mark}', ({value})::VARCHAR)"
    return f"""
  SELECT event_id AS log_id, event_id AS seq, 'INC-' || user_id || '-' || strftime(ts, '%d') AS incident_id,
         CASE event_id % {_HEADERS}
           WHEN 0 THEN strftime(ts, '%Y-%m-%dT%H:%M:%SZ') || ' ' || lvl || ' [svc' || svc || '] ' || msg
           WHEN 1 THEN strftime(ts, '%b %-d %H:%M:%S') || ' host' || svc || ' svc[' || user_id || ']: ' || lvl || ' ' || msg
           WHEN 2 THEN strftime(ts, '%Y-%m-%d %H:%M:%S') || ' - app' || svc || '.service ' || lvl || ' ' || msg
           WHEN 3 THEN (event_id + 1700000000) || ' ' || lvl || ' (job-' || svc || ') ' || msg
           WHEN 4 THEN '10.0.' || svc || '.1 - - ' || strftime(ts, '%d/%b/%Y:%H:%M:%S') || ' +0000 ' || lvl || ' ' || msg
           ELSE '  worker-' || svc || ' | ' || lvl || ': ' || msg || ' ' END AS raw_log,
         CASE WHEN event_id % {_CALLER_SOURCES} = 0 THEN 'caller-' || svc END AS source
  FROM (SELECT event_id, user_id, ts, user_id % 10 AS svc,
               ({_sql_list(LEVELS)})[(event_id // {_HEADERS}) % {len(LEVELS)} + 1] AS lvl,
               {message} AS msg
        FROM events)"""
