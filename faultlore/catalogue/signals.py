"""Matching signals of the built-in rules.

Everything in this module is a fixed value: rule ids, names, categories,
severities, regexes, keywords, error codes and modifier conditions are the
published interface of the rule set, and a line is only explained the same way
everywhere if they agree to the letter.  Registration order matters too: it
breaks ties between rules of equal confidence.  The prose that goes with each
rule is our own and lives in ``advice.py``.
"""

from __future__ import annotations

from typing import NamedTuple


class Signal(NamedTuple):
    rule_id: str
    name: str
    category: str
    severity: str
    patterns: tuple[str, ...]
    keywords: tuple[str, ...]
    error_codes: tuple[str, ...] = ()
    # (condition regex, raised severity), tested in this order
    modifiers: tuple[tuple[str, str], ...] = ()


# Fixed values from here on.  Regexes are case-insensitive and unanchored.

DATABASE = (
    Signal(
        "DB_CONN_REFUSED", "Database Connection Refused", "database", "HIGH",
        (
            r"connection\s+refused.*(?:5432|3306|27017|6379|1433)",
            r"ECONNREFUSED.*(?:5432|3306|27017|6379|1433)",
            r"ECONNREFUSED.*(?:postgres|mysql|mongo|redis|mssql)",
            r"could\s+not\s+connect\s+to\s+(?:server|database)",
            r"connection\s+to\s+.*\s+refused",
        ),
        ("connection refused", "ECONNREFUSED", "could not connect"),
        ("ECONNREFUSED", "CR_CONN_HOST_ERROR"),
        ((r"production|prod", "CRITICAL"),),
    ),
    Signal(
        "DB_TIMEOUT", "Database Query Timeout", "database", "HIGH",
        (
            r"query\s+timed?\s*out",
            r"statement\s+timeout",
            r"lock\s+wait\s+timeout\s+exceeded",
            r"canceling\s+statement\s+due\s+to\s+statement\s+timeout",
            r"Error\s+Code:\s*1205",
        ),
        ("query timeout", "statement timeout", "lock wait timeout"),
        ("1205", "57014"),
    ),
    Signal(
        "DB_AUTH_FAILED", "Database Authentication Failed", "database", "HIGH",
        (
            r"password\s+authentication\s+failed",
            r"access\s+denied\s+for\s+user",
            r"authentication\s+failed.*database",
            r"Login\s+failed\s+for\s+user",
            r"FATAL:\s+password\s+authentication\s+failed\s+for\s+user",
        ),
        ("authentication failed", "access denied", "login failed", "password"),
        ("28P01", "1045", "18456"),
    ),
    Signal(
        "DB_POOL_EXHAUSTED", "Database Connection Pool Exhausted", "database", "CRITICAL",
        (
            r"connection\s+pool\s+(?:exhausted|full|maxed|saturated)",
            r"too\s+many\s+connections",
            r"remaining\s+connection\s+slots\s+are\s+reserved",
            r"FATAL:\s+too\s+many\s+connections",
            r"max_connections",
        ),
        ("connection pool", "too many connections", "pool exhausted"),
        ("53300",),
    ),
    Signal(
        "DB_REPLICATION_LAG", "Database Replication Lag", "database", "MEDIUM",
        (
            r"replication\s+lag",
            r"slave\s+(?:is\s+)?behind\s+master",
            r"replica.*behind",
            r"Seconds_Behind_Master:\s*\d+",
        ),
        ("replication lag", "slave behind", "replica behind"),
        (),
        ((r"lag.*(?:\d{3,}|seconds)", "HIGH"),),
    ),
)

NETWORK = (
    Signal(
        "NET_CONN_TIMEOUT", "Network Connection Timeout", "network", "HIGH",
        (
            r"ETIMEDOUT",
            r"connection\s+timed?\s*out",
            r"connect\s+ETIMEDOUT",
            r"network\s+timeout",
            r"socket\s+timeout",
        ),
        ("ETIMEDOUT", "connection timeout", "socket timeout"),
        ("ETIMEDOUT",),
    ),
    Signal(
        "NET_DNS_FAILURE", "DNS Resolution Failure", "dns", "HIGH",
        (
            r"ENOTFOUND",
            r"getaddrinfo\s+ENOTFOUND",
            r"DNS.*(?:fail|error|timeout)",
            r"name\s+resolution.*failed",
            r"could\s+not\s+resolve\s+host",
            r"NXDOMAIN",
        ),
        ("ENOTFOUND", "DNS", "name resolution", "getaddrinfo"),
        ("ENOTFOUND", "NXDOMAIN"),
    ),
    Signal(
        "NET_CONN_RESET", "Connection Reset by Peer", "network", "MEDIUM",
        (
            r"ECONNRESET",
            r"connection\s+reset\s+by\s+peer",
            r"read\s+ECONNRESET",
            r"broken\s+pipe",
            r"EPIPE",
        ),
        ("ECONNRESET", "connection reset", "broken pipe", "EPIPE"),
        ("ECONNRESET", "EPIPE"),
        ((r"repeated|multiple|frequent", "HIGH"),),
    ),
    Signal(
        "NET_SSL_ERROR", "SSL/TLS Handshake Error", "ssl_tls", "HIGH",
        (
            r"SSL.*(?:handshake|error|fail)",
            r"TLS.*(?:handshake|error|fail)",
            r"certificate.*(?:expired|invalid|untrusted|verify)",
            r"UNABLE_TO_VERIFY_LEAF_SIGNATURE",
            r"CERT_HAS_EXPIRED",
            r"DEPTH_ZERO_SELF_SIGNED_CERT",
            r"ERR_TLS_CERT_ALTNAME_INVALID",
            r"self[\s-]signed\s+certificate",
        ),
        ("SSL", "TLS", "certificate", "handshake", "self-signed"),
        (
            "UNABLE_TO_VERIFY_LEAF_SIGNATURE",
            "CERT_HAS_EXPIRED",
            "DEPTH_ZERO_SELF_SIGNED_CERT",
            "ERR_TLS_CERT_ALTNAME_INVALID",
        ),
        ((r"expired", "CRITICAL"),),
    ),
    Signal(
        "NET_PORT_IN_USE", "Port Already in Use", "network", "MEDIUM",
        (
            r"EADDRINUSE",
            r"address\s+already\s+in\s+use",
            r"port.*already\s+(?:in\s+use|bound|taken)",
            r"bind.*EADDRINUSE",
        ),
        ("EADDRINUSE", "address in use", "port in use"),
        ("EADDRINUSE",),
    ),
)

AUTH = (
    Signal(
        "AUTH_LOGIN_FAILED", "Authentication Login Failed", "authentication", "MEDIUM",
        (
            r"authentication\s+fail",
            r"login\s+fail",
            r"invalid\s+(?:credentials|username|password)",
            r"unauthorized.*login",
            r"failed\s+password\s+for",
            r"pam_unix.*authentication\s+failure",
        ),
        ("login failed", "authentication failure", "invalid credentials", "failed password"),
        (),
        (
            (r"repeated|multiple|brute|consecutive", "CRITICAL"),
            (r"root|admin|administrator", "HIGH"),
        ),
    ),
    Signal(
        "AUTH_TOKEN_EXPIRED", "JWT/Session Token Expired", "authentication", "LOW",
        (
            r"token.*expired",
            r"jwt.*expired",
            r"session.*expired",
            r"TokenExpiredError",
            r"invalid.*token",
            r"token.*invalid",
        ),
        ("token expired", "JWT", "session expired", "TokenExpiredError"),
        ("TokenExpiredError",),
        ((r"service[\s-]to[\s-]service|machine|internal", "HIGH"),),
    ),
    Signal(
        "AUTH_PERMISSION_DENIED", "Permission/Authorization Denied", "authorization", "MEDIUM",
        (
            r"permission\s+denied",
            r"access\s+denied",
            r"forbidden",
            r"not\s+authorized",
            r"insufficient\s+(?:privileges|permissions)",
            r"EACCES",
            r"HTTP\s+403",
            r"403\s+Forbidden",
        ),
        ("permission denied", "access denied", "forbidden", "403", "EACCES"),
        ("EACCES", "403"),
        ((r"admin|root|system|superuser", "HIGH"),),
    ),
    Signal(
        "AUTH_BRUTE_FORCE", "Brute Force Attack Detected", "security", "CRITICAL",
        (
            r"brute[\s-]?force",
            r"too\s+many\s+(?:failed\s+)?(?:login|auth)\s+attempts",
            r"account\s+locked.*(?:failed|attempts)",
            r"rate\s+limit.*(?:auth|login)",
            r"multiple\s+failed\s+login",
        ),
        ("brute force", "account locked", "too many attempts", "failed login attempts"),
    ),
)

SYSTEM = (
    Signal(
        "SYS_OOM", "Out of Memory (OOM)", "memory", "CRITICAL",
        (
            r"out\s+of\s+memory",
            r"OOM\s*(?:killer|kill)",
            r"cannot\s+allocate\s+memory",
            r"ENOMEM",
            r"heap\s+out\s+of\s+memory",
            r"JavaScript\s+heap\s+out\s+of\s+memory",
            r"java\.lang\.OutOfMemoryError",
            r"MemoryError",
            r"fatal\s+error.*allocation\s+failed",
        ),
        ("out of memory", "OOM", "ENOMEM", "heap", "MemoryError"),
        ("ENOMEM",),
    ),
    Signal(
        "SYS_DISK_FULL", "Disk Space Full", "disk", "CRITICAL",
        (
            r"no\s+space\s+left\s+on\s+device",
            r"disk\s+(?:full|space.*(?:low|critical|exhausted))",
            r"ENOSPC",
            r"filesystem.*(?:full|100%)",
            r"write.*failed.*no\s+space",
        ),
        ("no space left", "disk full", "ENOSPC", "filesystem full"),
        ("ENOSPC",),
    ),
    Signal(
        "SYS_CPU_HIGH", "High CPU Utilization", "cpu", "HIGH",
        (
            r"cpu\s+(?:usage|utilization).*(?:high|100|9[0-9])",
            r"load\s+average.*(?:high|critical)",
            r"cpu.*(?:spike|overload|throttl)",
            r"process.*consuming.*cpu",
        ),
        ("CPU high", "CPU usage", "load average", "CPU spike", "CPU throttl"),
        (),
        ((r"100%|sustained|prolonged", "CRITICAL"),),
    ),
    Signal(
        "SYS_PROCESS_CRASH", "Process Crash / Segmentation Fault", "process", "CRITICAL",
        (
            r"segmentation\s+fault",
            r"segfault",
            r"SIGSEGV",
            r"SIGABRT",
            r"core\s+dumped",
            r"process.*(?:crash|died|terminated|killed)",
            r"unhandled\s+(?:exception|error|rejection)",
            r"fatal\s+error",
        ),
        ("segfault", "SIGSEGV", "core dump", "crash", "fatal error", "unhandled exception"),
        ("SIGSEGV", "SIGABRT", "SIGKILL"),
    ),
    Signal(
        "SYS_FILE_NOT_FOUND", "File or Directory Not Found", "filesystem", "MEDIUM",
        (
            r"no\s+such\s+file\s+or\s+directory",
            r"ENOENT",
            r"FileNotFoundException",
            r"file\s+not\s+found",
            r"path.*(?:does\s+not\s+exist|not\s+found)",
        ),
        ("ENOENT", "file not found", "no such file", "FileNotFoundException"),
        ("ENOENT",),
        ((r"config|env|\.env|settings|application\.(?:yml|properties)", "HIGH"),),
    ),
)

API = (
    Signal(
        "API_RATE_LIMITED", "API Rate Limit Exceeded", "api", "MEDIUM",
        (
            r"rate\s*limit.*exceeded",
            r"429\s+Too\s+Many\s+Requests",
            r"HTTP\s+429",
            r"throttl",
            r"too\s+many\s+requests",
            r"quota.*exceeded",
        ),
        ("rate limit", "429", "too many requests", "throttle", "quota exceeded"),
        ("429",),
        ((r"payment|billing|critical.*api", "HIGH"),),
    ),
    Signal(
        "API_TIMEOUT", "API Request Timeout", "timeout", "HIGH",
        (
            r"request\s+timed?\s*out",
            r"gateway\s+time[\s-]?out",
            r"504\s+Gateway\s+Time[\s-]?out",
            r"HTTP\s+504",
            r"upstream\s+timed?\s*out",
            r"proxy.*timeout",
        ),
        ("request timeout", "gateway timeout", "504", "upstream timeout"),
        ("504",),
    ),
    Signal(
        "API_BAD_REQUEST", "Bad Request / Validation Error", "api", "LOW",
        (
            r"400\s+Bad\s+Request",
            r"HTTP\s+400",
            r"validation\s+(?:error|fail)",
            r"invalid\s+(?:request|payload|input|parameter)",
            r"malformed\s+(?:JSON|request|body)",
            r"SyntaxError.*JSON",
        ),
        ("400", "bad request", "validation error", "invalid request", "malformed JSON"),
        ("400",),
    ),
    Signal(
        "API_INTERNAL_ERROR", "Internal Server Error", "application", "HIGH",
        (
            r"500\s+Internal\s+Server\s+Error",
            r"HTTP\s+500",
            r"internal\s+server\s+error",
            r"unhandled.*(?:error|exception)",
            r"unexpected\s+error",
        ),
        ("500", "internal server error", "unhandled exception", "unexpected error"),
        ("500",),
        ((r"repeated|frequent|multiple", "CRITICAL"),),
    ),
    Signal(
        "API_SERVICE_UNAVAILABLE", "Service Unavailable", "api", "CRITICAL",
        (
            r"503\s+Service\s+Unavailable",
            r"HTTP\s+503",
            r"service\s+unavailable",
            r"server\s+(?:is\s+)?(?:down|unavailable|overloaded)",
            r"maintenance\s+mode",
        ),
        ("503", "service unavailable", "server down", "maintenance"),
        ("503",),
    ),
    Signal(
        "API_CORS_ERROR", "CORS Policy Error", "api", "MEDIUM",
        (
            r"CORS.*(?:error|policy|block)",
            r"Access-Control-Allow-Origin",
            r"cross[\s-]?origin.*block",
            r"No 'Access-Control-Allow-Origin' header",
            r"preflight.*fail",
        ),
        ("CORS", "cross-origin", "Access-Control-Allow-Origin", "preflight"),
    ),
)

CONFIG = (
    Signal(
        "CFG_ENV_MISSING", "Missing Environment Variable", "configuration", "HIGH",
        (
            r"(?:env|environment)\s*(?:var|variable)?.*(?:missing|not\s+set|undefined|not\s+found|required)",
            r"missing\s+(?:required\s+)?(?:env|environment|config)",
            r"undefined.*(?:env|environment|config|process\.env)",
            r"config.*(?:not\s+found|missing|required)",
        ),
        ("environment variable", "env missing", "config not found", "undefined env"),
    ),
    Signal(
        "CFG_PORT_CONFLICT", "Port Configuration Conflict", "configuration", "MEDIUM",
        (
            r"port.*(?:conflict|mismatch|incorrect)",
            r"listen.*(?:EACCES|EADDRINUSE)",
            r"permission\s+denied.*port",
        ),
        ("port conflict", "EACCES port", "port permission"),
        ("EACCES",),
    ),
    Signal(
        "CFG_DEPENDENCY_ERROR", "Module/Dependency Not Found", "application", "HIGH",
        (
            r"cannot\s+find\s+module",
            r"MODULE_NOT_FOUND",
            r"ModuleNotFoundError",
            r"ImportError.*No\s+module\s+named",
            r"ClassNotFoundException",
            r"require.*not\s+found",
        ),
        ("cannot find module", "MODULE_NOT_FOUND", "ImportError", "dependency"),
        ("MODULE_NOT_FOUND",),
    ),
)

KUBERNETES = (
    Signal(
        "K8S_POD_CRASHLOOP", "Pod CrashLoopBackOff", "kubernetes", "CRITICAL",
        (
            r"CrashLoopBackOff",
            r"Back-off\s+restarting\s+failed\s+container",
            r"back-off.*restart",
            r"container.*crash.*loop",
        ),
        ("CrashLoopBackOff", "restart", "back-off", "pod crash"),
    ),
    Signal(
        "K8S_IMAGE_PULL_FAIL", "Image Pull Failed", "kubernetes", "HIGH",
        (
            r"ImagePullBackOff",
            r"ErrImagePull",
            r"Failed\s+to\s+pull\s+image",
            r"image.*(?:not\s+found|pull\s+error)",
            r"repository\s+does\s+not\s+exist",
        ),
        ("ImagePullBackOff", "ErrImagePull", "image pull", "pull failed"),
    ),
    Signal(
        "K8S_OOM_KILLED", "Container OOMKilled", "kubernetes", "CRITICAL",
        (
            r"OOMKilled",
            r"container.*killed.*oom",
            r"memory\s+cgroup\s+out\s+of\s+memory",
            r"Killed\s+process.*oom",
            r"exit\s+code\s+137",
        ),
        ("OOMKilled", "exit code 137", "out of memory", "cgroup", "killed"),
        ("137",),
    ),
    Signal(
        "K8S_NODE_NOT_READY", "Node NotReady", "kubernetes", "CRITICAL",
        (
            r"node.*NotReady",
            r"NodeNotReady",
            r"node\s+condition.*Ready.*False",
            r"kubelet\s+stopped\s+posting\s+node\s+status",
        ),
        ("NotReady", "NodeNotReady", "node condition", "kubelet"),
    ),
    Signal(
        "K8S_LIVENESS_FAIL", "Liveness/Readiness Probe Failed", "kubernetes", "HIGH",
        (
            r"Liveness\s+probe\s+failed",
            r"Readiness\s+probe\s+failed",
            r"probe\s+failed.*HTTP\s+probe",
            r"Startup\s+probe\s+failed",
            r"Unhealthy",
        ),
        ("liveness probe", "readiness probe", "health check", "unhealthy"),
    ),
    Signal(
        "K8S_EVICTION", "Pod Evicted", "kubernetes", "HIGH",
        (
            r"pod.*evict",
            r"Evicted",
            r"The\s+node\s+was\s+low\s+on\s+resource",
            r"eviction.*threshold",
            r"DiskPressure",
            r"MemoryPressure",
            r"PIDPressure",
        ),
        ("evicted", "eviction", "DiskPressure", "MemoryPressure", "PIDPressure"),
    ),
    Signal(
        "K8S_RBAC_DENIED", "RBAC Permission Denied", "kubernetes", "HIGH",
        (
            r"forbidden.*RBAC",
            r"cannot.*(?:get|list|watch|create|update|delete).*(?:pods|services|deployments|secrets)",
            r"User.*cannot",
            r"is\s+forbidden",
        ),
        ("forbidden", "RBAC", "cannot", "permission", "service account"),
    ),
)

DOCKER = (
    Signal(
        "DOCKER_DAEMON_ERROR", "Docker Daemon Error", "docker", "CRITICAL",
        (
            r"docker\s+daemon.*(?:error|fail|not\s+running)",
            r"Cannot\s+connect\s+to\s+the\s+Docker\s+daemon",
            r"Is\s+the\s+docker\s+daemon\s+running",
            r"docker\.sock.*(?:permission|denied|not\s+found)",
        ),
        ("docker daemon", "docker.sock", "dockerd", "daemon not running"),
    ),
    Signal(
        "DOCKER_BUILD_FAIL", "Docker Build Failed", "docker", "HIGH",
        (
            r"(?:docker|buildx?)\s+build.*(?:error|fail)",
            r"COPY\s+failed.*(?:file\s+not\s+found|no\s+such\s+file)",
            r"RUN.*returned\s+a\s+non-zero\s+code",
            r"failed\s+to\s+compute\s+cache\s+key",
            r"executor\s+failed\s+running",
        ),
        ("docker build", "Dockerfile", "build failed", "COPY failed", "RUN failed"),
    ),
    Signal(
        "DOCKER_CONTAINER_EXIT", "Container Exited Unexpectedly", "docker", "HIGH",
        (
            r"container.*exited\s+with\s+code\s+[1-9]",
            r"Exited\s+\([1-9]\d*\)",
            r"container.*died",
            r"process.*exited.*status\s+[1-9]",
        ),
        ("exited", "container died", "exit code", "non-zero"),
    ),
    Signal(
        "DOCKER_NETWORK_ERROR", "Docker Network Error", "docker", "MEDIUM",
        (
            r"docker.*network.*(?:error|fail|not\s+found)",
            r"failed\s+to\s+(?:create|join|connect)\s+(?:to\s+)?network",
            r"network\s+.*?\s+not\s+found",
            r"endpoint.*already\s+exists\s+in\s+network",
        ),
        ("docker network", "network not found", "endpoint", "bridge"),
    ),
    Signal(
        "DOCKER_VOLUME_ERROR", "Docker Volume Mount Error", "docker", "HIGH",
        (
            r"volume.*(?:error|fail|not\s+found|permission)",
            r"bind\s+mount.*(?:denied|error|fail)",
            r"mount.*(?:denied|error|fail).*container",
            r"invalid\s+mount\s+config",
        ),
        ("volume", "mount", "bind mount", "volume error"),
    ),
)

CLOUD = (
    Signal(
        "CLOUD_LAMBDA_TIMEOUT", "Lambda/Cloud Function Timeout", "cloud", "HIGH",
        (
            r"Task\s+timed\s+out\s+after\s+\d+.*seconds",
            r"Lambda.*timeout",
            r"FUNCTION_INVOCATION_TIMEOUT",
            r"Function\s+execution\s+took\s+\d+\s+ms.*finished\s+with\s+status.*timeout",
            r"cloud\s*function.*timed?\s*out",
        ),
        ("Lambda", "timeout", "cloud function", "function invocation", "serverless"),
    ),
    Signal(
        "CLOUD_LAMBDA_MEMORY", "Lambda/Function Out of Memory", "cloud", "HIGH",
        (
            r"Runtime\.ExitError",
            r"RequestId.*Process\s+exited\s+before\s+completing",
            r"FUNCTION_INVOCATION_FAILED",
            r"memory\s+size.*exceeded",
            r"Runtime\.OutOfMemory",
        ),
        ("Lambda", "out of memory", "function invocation failed", "Runtime.ExitError"),
    ),
    Signal(
        "CLOUD_S3_ACCESS_DENIED", "S3/Storage Access Denied", "cloud", "HIGH",
        (
            r"AccessDenied.*(?:S3|s3|bucket)",
            r"Access\s+Denied.*(?:storage|blob|bucket|object)",
            r"NoSuchBucket",
            r"NoSuchKey",
            r"Storage.*permission.*denied",
            r"403.*(?:S3|bucket|storage)",
        ),
        ("S3", "AccessDenied", "bucket", "storage", "NoSuchBucket", "NoSuchKey"),
        ("AccessDenied", "NoSuchBucket", "NoSuchKey", "403"),
    ),
    Signal(
        "CLOUD_THROTTLING", "Cloud API Throttling", "cloud", "MEDIUM",
        (
            r"Throttling",
            r"Rate\s+exceeded",
            r"TooManyRequestsException",
            r"SlowDown",
            r"ProvisionedThroughputExceededException",
            r"ThrottlingException",
            r"API\s+rate\s+limit\s+exceeded",
        ),
        ("throttling", "rate exceeded", "SlowDown", "TooManyRequests", "provisioned throughput"),
        ("Throttling", "SlowDown", "TooManyRequestsException"),
        ((r"repeated|sustained|continuous", "HIGH"),),
    ),
    Signal(
        "CLOUD_IAM_ERROR", "IAM Authentication/Authorization Error", "cloud", "HIGH",
        (
            r"UnauthorizedAccess",
            r"InvalidClientTokenId",
            r"SignatureDoesNotMatch",
            r"ExpiredToken",
            r"AssumeRole.*(?:fail|denied|error)",
            r"sts.*(?:error|fail|denied)",
            r"credentials.*(?:expired|invalid|not\s+found)",
        ),
        ("IAM", "credentials", "AssumeRole", "STS", "unauthorized", "expired token"),
        ("InvalidClientTokenId", "SignatureDoesNotMatch", "ExpiredToken"),
    ),
)

MESSAGING = (
    Signal(
        "MQ_CONNECTION_LOST", "Message Broker Connection Lost", "messaging", "HIGH",
        (
            r"(?:rabbit|amqp|kafka|redis|nats).*connection.*(?:lost|closed|refused|fail)",
            r"broker.*(?:disconnected|unreachable|down)",
            r"AMQP.*(?:error|connection|closed)",
            r"KafkaJSConnectionError",
            r"lost\s+connection\s+to\s+(?:broker|queue|message)",
        ),
        ("RabbitMQ", "Kafka", "AMQP", "broker", "connection lost", "message queue"),
    ),
    Signal(
        "MQ_CONSUMER_LAG", "Message Consumer Lag", "messaging", "MEDIUM",
        (
            r"consumer\s+(?:lag|behind|falling\s+behind)",
            r"message.*backlog",
            r"queue\s+(?:depth|size).*(?:high|growing|exceeded)",
            r"offset.*lag",
            r"unacked.*(?:messages|count).*(?:high|growing)",
        ),
        ("consumer lag", "backlog", "queue depth", "offset lag", "unacked messages"),
        (),
        ((r"critical|emergency|very\s+high", "HIGH"),),
    ),
    Signal(
        "MQ_DEAD_LETTER", "Dead Letter Queue Message", "messaging", "MEDIUM",
        (
            r"dead[.\s-]?letter",
            r"DLQ",
            r"message.*(?:rejected|failed|undeliverable)",
            r"max\s+retries?\s+exceeded",
            r"message.*poison",
        ),
        ("dead letter", "DLQ", "rejected", "max retries", "poison message", "undeliverable"),
    ),
    Signal(
        "MQ_PUBLISH_FAIL", "Message Publish Failed", "messaging", "HIGH",
        (
            r"(?:publish|produce|send).*(?:fail|error|timeout).*(?:message|queue|topic)",
            r"message.*(?:not\s+)?(?:publish|deliver|sent)",
            r"KafkaJSNumberOfRetriesExceeded",
            r"channel\s+closed",
            r"exchange.*not\s+found",
        ),
        ("publish failed", "produce error", "message delivery", "channel closed"),
    ),
)

INFRASTRUCTURE = (
    Signal(
        "CACHE_REDIS_ERROR", "Redis Connection/Command Error", "caching", "HIGH",
        (
            r"redis.*(?:connection\s+refused|ECONNREFUSED)",
            r"Redis.*(?:error|fail|timeout|NOAUTH|WRONGPASS)",
            r"NOAUTH\s+Authentication\s+required",
            r"ERR\s+max\s+number\s+of\s+clients\s+reached",
            r"redis.*LOADING",
        ),
        ("Redis", "ECONNREFUSED", "NOAUTH", "cache error", "redis timeout"),
        ("NOAUTH", "WRONGPASS"),
    ),
    Signal(
        "CACHE_MISS_SPIKE", "Cache Miss Rate Spike", "caching", "MEDIUM",
        (
            r"cache\s+miss.*(?:rate|spike|high|increased)",
            r"cache\s+hit\s+ratio.*(?:low|dropped|declining)",
            r"cache.*(?:cold|warming|invalidated|flushed)",
            r"cache\s+stampede",
        ),
        ("cache miss", "cache hit ratio", "cache cold", "stampede"),
    ),
    Signal(
        "EMAIL_SMTP_ERROR", "SMTP Email Delivery Error", "email", "MEDIUM",
        (
            r"SMTP.*(?:error|fail|refused|timeout)",
            r"(?:mail|email).*(?:delivery|send).*(?:fail|error|bounce)",
            r"(?:550|552|554).*(?:rejected|denied|spam|relay)",
            r"EHLO.*fail",
            r"authentication.*fail.*(?:smtp|mail)",
        ),
        ("SMTP", "email", "delivery failed", "bounce", "rejected", "mail server"),
        ("550", "552", "554", "450", "451"),
        ((r"password\s+reset|verification|critical\s+notification", "HIGH"),),
    ),
    Signal(
        "LOG_ROTATION_FAIL", "Log Rotation Failure", "logging", "MEDIUM",
        (
            r"log\s*rotation.*(?:fail|error)",
            r"logrotate.*(?:error|fail)",
            r"unable\s+to\s+(?:rotate|truncate).*log",
            r"log\s+file.*(?:too\s+large|exceeded|growing)",
        ),
        ("logrotate", "log rotation", "log file size", "log truncate"),
    ),
    Signal(
        "NGINX_BAD_GATEWAY", "Nginx Bad Gateway (502)", "api", "HIGH",
        (
            r"502\s+Bad\s+Gateway",
            r"HTTP\s+502",
            r"upstream\s+prematurely\s+closed\s+connection",
            r"no\s+live\s+upstreams",
            r"connect\(\)\s+failed.*upstream",
        ),
        ("502", "bad gateway", "upstream", "nginx", "proxy"),
        ("502",),
    ),
    Signal(
        "DB_DEADLOCK", "Database Deadlock Detected", "database", "HIGH",
        (
            r"deadlock\s+detected",
            r"Deadlock\s+found",
            r"deadlock.*victim",
            r"transaction.*deadlock",
            r"Error\s+1213",
        ),
        ("deadlock", "deadlock detected", "deadlock victim", "transaction conflict"),
        ("1213", "40P01"),
    ),
    Signal(
        "APP_STACK_OVERFLOW", "Stack Overflow / Recursion Limit", "application", "HIGH",
        (
            r"stack\s*overflow",
            r"Maximum\s+call\s+stack\s+size\s+exceeded",
            r"RecursionError",
            r"StackOverflowError",
            r"maximum\s+recursion\s+depth\s+exceeded",
        ),
        ("stack overflow", "recursion", "call stack", "RecursionError"),
    ),
    Signal(
        "APP_UNHANDLED_PROMISE", "Unhandled Promise Rejection", "application", "HIGH",
        (
            r"UnhandledPromiseRejection",
            r"unhandled\s+promise\s+rejection",
            r"PromiseRejectionHandledWarning",
            r"Unhandled\s+Rejection",
            r"unhandled.*(?:error|rejection).*(?:promise|async)",
        ),
        ("unhandled promise", "rejection", "promise rejection", "async error"),
        (),
        ((r"process.*exit|crash|terminate", "CRITICAL"),),
    ),
    Signal(
        "APP_TYPE_ERROR", "TypeError / Null Reference", "application", "MEDIUM",
        (
            r"TypeError.*(?:undefined|null|not\s+a\s+function|not\s+iterable)",
            r"Cannot\s+read\s+propert.*of\s+(?:undefined|null)",
            r"NullPointerException",
            r"NullReferenceException",
            r"AttributeError.*NoneType",
            r"is\s+not\s+a\s+function",
        ),
        ("TypeError", "undefined", "null", "NullPointerException", "NullReferenceException"),
        (),
        ((r"production|prod|live", "HIGH"),),
    ),
    Signal(
        "APP_MEMORY_LEAK", "Memory Leak Detected", "memory", "HIGH",
        (
            r"memory\s+leak",
            r"heap\s+(?:size|used|total).*(?:growing|increasing|exceeded)",
            r"possible\s+memory\s+leak",
            r"EventEmitter\s+memory\s+leak",
            r"MaxListenersExceeded",
            r"--max-old-space-size",
        ),
        ("memory leak", "heap growing", "EventEmitter", "MaxListenersExceeded"),
    ),
    Signal(
        "APP_CORS_PREFLIGHT", "CORS Preflight Request Failure", "api", "MEDIUM",
        (
            r"preflight.*(?:fail|error|blocked)",
            r"OPTIONS.*(?:405|403|blocked)",
            r"No\s+'Access-Control-Allow-Origin'",
            r"CORS.*header.*missing",
            r"Method\s+not\s+allowed.*OPTIONS",
        ),
        ("preflight", "OPTIONS", "CORS", "Access-Control", "cross-origin"),
    ),
    Signal(
        "APP_TIMEZONE_ERROR", "Timezone / Date Parsing Error", "application", "LOW",
        (
            r"(?:invalid|unexpected)\s+(?:date|time)",
            r"timezone.*(?:error|invalid|mismatch)",
            r"RangeError.*Invalid\s+time\s+value",
            r"NaN.*(?:date|time|timestamp)",
            r"date.*parsing.*(?:fail|error)",
        ),
        ("invalid date", "timezone error", "time parsing", "NaN date", "timestamp"),
        (),
        ((r"billing|payment|schedule|cron|deadline", "HIGH"),),
    ),
)

# Registration order of the groups.
SIGNALS: tuple[Signal, ...] = (
    DATABASE + NETWORK + AUTH + SYSTEM + API + CONFIG
    + KUBERNETES + DOCKER + CLOUD + MESSAGING + INFRASTRUCTURE
)

# Every category a rule may carry.
CATEGORIES: tuple[str, ...] = (
    "database", "network", "authentication", "authorization", "memory", "disk",
    "cpu", "api", "timeout", "configuration", "security", "application",
    "filesystem", "dns", "ssl_tls", "process", "kernel", "kubernetes", "docker",
    "messaging", "cloud", "caching", "email", "logging", "unknown",
)
