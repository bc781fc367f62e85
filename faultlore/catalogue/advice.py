"""Plain-English advice that goes with each built-in rule.

The wording is this project's own.  Each entry gives the summary, the root
cause, possible causes, recommended fixes and, where the rule has severity
modifiers, one reason per modifier in the order of ``signals.py``.
"""

from __future__ import annotations

from typing import NamedTuple


class Advice(NamedTuple):
    summary: str
    root_cause: str
    causes: tuple[str, ...]
    fixes: tuple[str, ...]
    modifier_reasons: tuple[str, ...] = ()


ADVICE: dict[str, Advice] = {
    "DB_CONN_REFUSED": Advice(
        "A client could not open a connection to its database because the port refused it.",
        "Nothing is accepting connections at the database address the client used.",
        ("The database process is stopped or still starting",
         "Host or port in the connection settings is wrong",
         "A firewall or security group rejects the database port",
         "The database accepts connections on a local socket only",
         "The server is at its connection limit and turns newcomers away",
         "A container or host name now points to another machine"),
        ("Confirm that the database process is up and listening",
         "Compare host and port in the connection settings with the server's",
         "Open the database port between the client and the server",
         "Let the server listen on the interface that clients use",
         "Check the server's log for a failed start",
         "Retry with a pause while the database starts"),
        ("A production database cannot be reached",)),
    "DB_TIMEOUT": Advice(
        "A database statement ran past its time limit and was cancelled.",
        "The statement was slow or waited on a lock for longer than allowed.",
        ("A missing index forces a full scan",
         "Another transaction holds the rows the statement needs",
         "The database host is short of CPU or I/O",
         "Statistics are stale, so the planner picks a poor plan",
         "The statement reads far more rows than it did at first",
         "A backup or maintenance job competes for the disk"),
        ("Look at the query plan and add the index it lacks",
         "Find and end the transaction that blocks others",
         "Raise the statement time limit only once the query is understood",
         "Refresh table statistics",
         "Read the rows in pages rather than all at once",
         "Move maintenance jobs to a quiet hour")),
    "DB_AUTH_FAILED": Advice(
        "The database rejected the credentials it was given.",
        "User name, password or host rule does not match what the database has on record.",
        ("The password was rotated but the client still has the old one",
         "The database user does not exist or lost its grants",
         "The server's host rules do not admit this client",
         "The password was cut or altered by quoting in the settings",
         "The server expects another authentication method",
         "The client connects to a database of another environment"),
        ("Test the same credentials with a database shell",
         "Update the stored database secret and restart the client",
         "Check grants and host access rules of the database user",
         "Quote special characters of the password in the connection string",
         "Bring client and server to one authentication method",
         "Read the server's log for the reason it gives")),
    "DB_POOL_EXHAUSTED": Advice(
        "No database connection is left in the pool, so new work has to wait or fail.",
        "More connections are held open than the pool or the server allows.",
        ("Connections are borrowed and never returned",
         "Slow queries keep connections busy",
         "Pool size times the number of instances exceeds the server limit",
         "A rise in traffic needs more connections at once",
         "Transactions stay open while other services are called",
         "Idle connections are never closed"),
        ("Look for code paths that do not release their connection",
         "Put a connection pooler between the services and the database",
         "Size the pools so that all instances stay under the server limit",
         "Return connections before calling other services",
         "Set a limit to the time that a connection may be held",
         "Watch the pool's use and alert before it is empty")),
    "DB_REPLICATION_LAG": Advice(
        "A database replica is behind its primary and may serve stale rows.",
        "The replica applies changes more slowly than the primary writes them.",
        ("A burst of writes or one very large transaction",
         "The replica host is weaker than the primary",
         "Long reads on the replica hold back replay",
         "The network between the two hosts is slow or lossy",
         "A table without a primary key is replayed row by row"),
        ("Watch the lag and send critical reads to the primary",
         "Split bulk writes into smaller transactions",
         "Give the replica more I/O or enable parallel replay",
         "Give every replicated table a primary key",
         "Check the bandwidth between primary and replica",
         "Rebuild the replica if it cannot catch up"),
        ("The lag is large enough to affect readers",)),
    "NET_CONN_TIMEOUT": Advice(
        "A network connection was not established or answered in time.",
        "Packets to the remote host get no answer within the time limit.",
        ("The remote host is down or overloaded",
         "A firewall silently drops the traffic",
         "Routing or peering between the networks is broken",
         "A proxy or VPN on the path is down",
         "The remote side's queue of pending connections is full",
         "The address is right but the port is not open"),
        ("Try the same address and port from the affected host",
         "Review firewall drops on the path",
         "Set a connect timeout with retry and back-off",
         "Check the state of proxies and VPN links",
         "Trace the route to see where packets end",
         "Ask the owner of the remote host for its health")),
    "NET_DNS_FAILURE": Advice(
        "A host name could not be resolved to an address.",
        "The resolver has no answer for the name, or does not answer at all.",
        ("The host name is misspelt or its record was removed",
         "The configured name server is unreachable",
         "A record change has not propagated yet",
         "A search domain of the host changes the name that is asked for",
         "The zone's registration or delegation has lapsed",
         "The resolver is overloaded and drops queries"),
        ("Query the name with dig against the configured resolver",
         "Correct the host name in the settings",
         "Restore the missing record or the resolver itself",
         "Check the host's resolver settings and search domains",
         "Verify the delegation and registration of the zone",
         "Cache answers locally so that short outages do not matter")),
    "NET_CONN_RESET": Advice(
        "The other side closed a connection while it was still in use.",
        "The peer, or a device on the path, ended the connection abruptly.",
        ("The peer process restarted or crashed",
         "A load balancer closed an idle connection",
         "The client sent more than the peer was willing to read",
         "A firewall forgot the connection and rejects its packets",
         "The peer speaks another protocol on this port",
         "The peer's limit of open connections was passed"),
        ("Match the reset with restarts of the peer",
         "Set keep-alive below the idle limit of the load balancer",
         "Retry requests that are safe to repeat",
         "Look at firewall and proxy logs at the time of the reset",
         "Confirm that both sides use the same protocol",
         "Capture packets to see which side resets"),
        ("Resets keep happening, which points to a wider fault",)),
    "NET_SSL_ERROR": Advice(
        "A secure connection failed because the handshake or the certificate was not accepted.",
        "The two sides do not agree on a certificate or a protocol version.",
        ("The certificate has run out or names another host",
         "The client lacks the issuing authority",
         "The two sides share no protocol version or cipher",
         "An intermediate certificate is not served",
         "The clock of one host is wrong",
         "A proxy replaces the certificate on the way"),
        ("Inspect the served chain with openssl s_client",
         "Renew the certificate and install the full chain",
         "Bring both sides to a common protocol version",
         "Correct the clocks of both hosts",
         "Add the issuing authority to the client's trust store",
         "Renew certificates by a job and alert before they end"),
        ("An expired certificate stops every secure client",)),
    "NET_PORT_IN_USE": Advice(
        "A service could not start because its port is already taken.",
        "Another process is bound to the same address and port.",
        ("An earlier instance did not shut down",
         "Two services are configured with one port",
         "The socket is still waiting to close",
         "A debugger or test run left a server behind",
         "Another user's process owns the port"),
        ("Find the process that holds the port with ss or lsof",
         "Stop that process or choose another port",
         "Wait for the old instance to exit before starting a new one",
         "Allow address reuse on the listening socket",
         "Take the port from the settings rather than from the code")),
    "AUTH_LOGIN_FAILED": Advice(
        "A login attempt was rejected.",
        "The presented identity and secret do not belong together.",
        ("A mistyped or outdated password",
         "The account does not exist or is disabled",
         "Somebody is guessing passwords",
         "The directory or identity service could not be asked",
         "The account is locked after earlier failures",
         "The second factor was wrong or late"),
        ("Check the attempt against the account's history",
         "Reset the password if the owner asks for it",
         "Limit login attempts per account and address",
         "Confirm that the identity service is up",
         "Unlock the account once its owner is known",
         "Watch for failures from unusual places"),
        ("Several failures in a row suggest password guessing",
         "The target is a privileged account")),
    "AUTH_TOKEN_EXPIRED": Advice(
        "A token or session was refused because it is no longer valid.",
        "The token's lifetime ended or its signature does not check out.",
        ("The client did not refresh its token in time",
         "Clocks of issuer and verifier differ",
         "The signing key was replaced",
         "The session was ended by a sign-out elsewhere",
         "The token was issued for another audience"),
        ("Refresh the token before it ends",
         "Synchronise clocks on all hosts",
         "Publish the new signing key to every verifier",
         "Ask the user to sign in again when a refresh fails",
         "Check audience and issuer of the token"),
        ("An expired machine token stops the services that rely on it",)),
    "AUTH_PERMISSION_DENIED": Advice(
        "An operation was refused because the caller lacks the permission.",
        "The caller is known, but its rights do not cover the resource.",
        ("A role or group membership is missing",
         "File ownership or mode excludes the process",
         "A policy was tightened recently",
         "The process runs under another user than intended",
         "A security module such as SELinux forbids the access",
         "The resource belongs to another tenant or project"),
        ("Compare the caller's roles with what the operation needs",
         "Correct ownership and mode of the resource",
         "Grant the narrowest role that allows the operation",
         "Check under which user the process runs",
         "Read the security module's audit log",
         "Record who granted the right, and review it later"),
        ("The refused resource is a privileged one",)),
    "AUTH_BRUTE_FORCE": Advice(
        "Login failures came so often that an attack is likely.",
        "Someone is trying many passwords against one or more accounts.",
        ("An automated password list attack",
         "Leaked credentials are being tried out",
         "A broken client keeps sending an old password",
         "The login page is open to the whole internet without a limit",
         "A scanner tries default accounts of common products"),
        ("Block the offending addresses",
         "Require a second factor on the affected accounts",
         "Reset passwords that may be known to others",
         "Slow down answers after repeated failures",
         "Search the log for a success among the failures",
         "Disable or rename default accounts",
         "Put the login behind a VPN or a challenge")),
    "SYS_OOM": Advice(
        "A process asked for more memory than was available.",
        "Memory demand went over the limit of the process or the host.",
        ("The memory limit is too small for the load",
         "Objects are kept alive that are no longer needed",
         "One request loads too much data at once",
         "Several processes on the host compete for memory",
         "There is no swap space to absorb a peak",
         "A cache inside the process has no limit"),
        ("Take a heap dump and look at the largest holders",
         "Raise the memory limit if the demand is justified",
         "Process large inputs in smaller pieces",
         "Restart the process to restore service for now",
         "Limit the size of caches inside the process",
         "Move other heavy processes to another host",
         "Watch memory use and alert before the limit")),
    "SYS_DISK_FULL": Advice(
        "A write failed because the disk has no room left.",
        "The file system is out of blocks or inodes.",
        ("Logs or temporary files are never removed",
         "Data grew faster than planned",
         "Deleted files are still held open",
         "Core dumps or crash reports pile up",
         "Old images, packages or builds are kept",
         "A quota of the user or project is used up"),
        ("Find the largest directories with du",
         "Rotate or remove old logs and temporary files",
         "Extend the volume and alert well before it fills",
         "Check free inodes as well as free blocks",
         "Restart processes that hold deleted files open",
         "Remove unused images, packages and builds",
         "Keep data and logs on separate volumes")),
    "SYS_CPU_HIGH": Advice(
        "The processor is close to saturation.",
        "Runnable work exceeds the processor time that is available.",
        ("A busy loop or an expensive query",
         "More traffic than the host can carry",
         "The container's processor limit is too low",
         "The runtime spends its time collecting garbage",
         "A scheduled job runs at the same time as users' work",
         "An unwanted program, such as a miner, is running"),
        ("Profile the busiest process",
         "Add instances or a larger host",
         "Revisit the processor limit of the container",
         "List processes by processor time",
         "Move scheduled jobs to a quiet hour",
         "Cache results that are computed again and again",
         "Check that every running program is wanted"),
        ("The processor has been saturated for a long time",)),
    "SYS_PROCESS_CRASH": Advice(
        "A process ended abnormally.",
        "The process hit a fault it could not handle and was stopped.",
        ("A defect such as an invalid memory access",
         "An exception that no code caught",
         "The operating system or an operator killed it",
         "A native library does not fit the platform",
         "Memory or another resource ran out",
         "A settings file is damaged"),
        ("Read the core dump or the last stack trace",
         "Undo the latest release if the crash is new",
         "Let a supervisor restart the process",
         "Keep core dumps so that the fault can be studied",
         "Check memory and disk at the time of the crash",
         "Compare library versions with a healthy host",
         "Run with the last good settings")),
    "SYS_FILE_NOT_FOUND": Advice(
        "A file or directory that was expected does not exist.",
        "The path is wrong, or the file was never created or has been removed.",
        ("The path is relative to another working directory",
         "A deployment left the file out",
         "Another process moved or deleted it",
         "Upper and lower case of the name differ",
         "A symbolic link points nowhere",
         "A volume is not mounted"),
        ("Print the absolute path the process uses",
         "Add the missing file to the deployment",
         "Check mounts of the directory",
         "Compare the spelling of the name, case included",
         "Resolve symbolic links on the path",
         "Create the file at start-up where it may be absent"),
        ("A missing settings file can keep a service from starting",)),
    "API_RATE_LIMITED": Advice(
        "Requests were rejected because a rate limit was reached.",
        "The caller sends more requests than its allowance.",
        ("A retry loop without a pause",
         "Traffic grew beyond the agreed quota",
         "Many clients share one key",
         "A scheduled job sends its calls all at once",
         "The limit was lowered by the provider",
         "Answers that could be cached are fetched each time"),
        ("Back off for as long as the Retry-After header says",
         "Cache or batch calls to the limited service",
         "Ask for a higher quota",
         "Spread scheduled calls over time",
         "Give each client a key of its own",
         "Count calls and slow down before the limit"),
        ("The limited service matters to the business",)),
    "API_TIMEOUT": Advice(
        "A request was given up because the answer took too long.",
        "A service further down did not answer within the time limit.",
        ("The service behind is slow or stuck",
         "A query or a lock delays the answer",
         "The time limit is shorter than the work needs",
         "The network between the services loses packets",
         "Threads or connections of the service are used up",
         "The answer is very large"),
        ("Trace the request to the slowest hop",
         "Tune the slow dependency",
         "Align time limits along the chain of services",
         "Page or compress large answers",
         "Break the circuit while the dependency is down",
         "Add capacity where requests wait in a queue")),
    "API_BAD_REQUEST": Advice(
        "A request was refused because its content is not valid.",
        "The caller sent data that does not fit the interface.",
        ("Required fields are missing or of the wrong type",
         "The body is not well-formed",
         "Client and server use different interface versions",
         "The content type does not match the body",
         "A value is outside its permitted range",
         "A proxy changed or cut the request"),
        ("Validate the request against the interface description",
         "Log the refused field for the client's owner",
         "Bring the client to the current interface version",
         "Send the content type that the server expects",
         "Return a message that names the field at fault",
         "Compare the request before and after the proxy")),
    "API_INTERNAL_ERROR": Advice(
        "A service failed while handling a request.",
        "The service met a condition its code does not handle.",
        ("A defect in a recent release",
         "A dependency failed in an unforeseen way",
         "Unusual input data",
         "A setting is missing on this instance",
         "Memory or connections ran out during the request",
         "The database schema does not match the code"),
        ("Find the stack trace of the failing request",
         "Roll back if the error began with a release",
         "Handle the failing case and add a test for it",
         "Compare settings and schema with a working instance",
         "Check resources at the time of the error",
         "Return an error id that can be found in the log"),
        ("The error keeps coming back",)),
    "API_SERVICE_UNAVAILABLE": Advice(
        "A service is not able to take requests at the moment.",
        "All instances are down, overloaded or in maintenance.",
        ("Instances fail their health checks",
         "Load exceeds capacity",
         "Planned maintenance is under way",
         "A new release is being rolled out to all instances at once",
         "The load balancer has no instance to send to",
         "A dependency is down and the service gives up with it"),
        ("Look at the health and number of instances",
         "Scale out or shed load",
         "Announce maintenance and retry later",
         "Replace instances one after another",
         "Check the targets of the load balancer",
         "Answer from a cache while the dependency is down")),
    "API_CORS_ERROR": Advice(
        "A browser blocked a request to another origin.",
        "The answer lacks the headers that allow the calling origin.",
        ("The calling origin is not on the allowed list",
         "A proxy removes the headers",
         "Error answers are sent without the headers",
         "Credentials are sent while every origin is allowed",
         "The scheme or port of the origin differs from the listed one",
         "The request carries a header that is not allowed"),
        ("Add the calling origin to the allowed list",
         "Keep cross-origin headers in the proxy",
         "Send the headers with error answers as well",
         "List origins by name where credentials are sent",
         "Compare scheme, host and port of the origin",
         "Allow the headers that clients send")),
    "CFG_ENV_MISSING": Advice(
        "A required setting is missing from the environment.",
        "The process was started without a variable or setting it needs.",
        ("The variable is not defined for this deployment",
         "The settings file was not loaded",
         "The name is spelt differently in code and deployment",
         "The secret store could not be read",
         "The variable is set for another user or shell",
         "A release needs a variable that was not announced"),
        ("List the variables the process really sees",
         "Define the missing variable in the deployment",
         "Check all required settings at start-up",
         "Check access to the secret store",
         "Document every variable beside the code",
         "Give harmless settings a default")),
    "CFG_PORT_CONFLICT": Advice(
        "A service cannot use the port it was configured with.",
        "The configured port is taken, privileged or not the expected one.",
        ("Ports below 1024 need extra rights",
         "Two services were given the same port number",
         "Port mapping and listening port differ",
         "The platform assigns a port that the program ignores"),
        ("Use a port above 1024 or grant the right to bind",
         "Give each service its own port",
         "Make the mapping agree with the listening port",
         "Read the port that the platform assigns")),
    "CFG_DEPENDENCY_ERROR": Advice(
        "A module or class the program needs could not be loaded.",
        "A dependency is not installed or not on the search path.",
        ("The dependency was not installed in this build",
         "The search path of the runtime is incomplete",
         "Versions of two packages do not fit together",
         "The module's name is spelt in another case",
         "A private package source could not be reached",
         "The build was made for another runtime version"),
        ("Install dependencies from the lock file",
         "Check the module or class path",
         "Pin package versions that work together",
         "Remove installed packages and install them afresh",
         "Check access to the private package source",
         "Use one runtime version for build and operation")),
    "K8S_POD_CRASHLOOP": Advice(
        "A pod keeps crashing and its restarts are being delayed.",
        "The container ends soon after every start.",
        ("The program fails at start-up",
         "A config map or secret is absent",
         "The liveness probe fires too early",
         "A service that the program needs is not reachable",
         "The container may not write where it has to",
         "The image holds another version than planned"),
        ("Read the previous container's log with kubectl logs --previous",
         "Check config maps, secrets and the start command",
         "Give the probe a longer initial delay",
         "Describe the pod and read its last state and exit code",
         "Check volumes and their rights",
         "Go back to the previous image")),
    "K8S_IMAGE_PULL_FAIL": Advice(
        "A container image could not be pulled.",
        "The registry does not have the image or does not let the node have it.",
        ("Image name or tag is wrong",
         "The registry secret is missing or out of date",
         "The node cannot reach the registry",
         "The registry limits the number of pulls",
         "The image was built for another processor type",
         "The image was removed by a clean-up rule"),
        ("Pull the image by hand from the node",
         "Renew the image pull secret",
         "Correct the tag in the manifest",
         "Mirror the image in a registry of your own",
         "Build the image for the nodes' processor type",
         "Exempt images in use from clean-up rules")),
    "K8S_OOM_KILLED": Advice(
        "A container was killed for exceeding its memory limit.",
        "The container used more memory than its limit allows.",
        ("The limit is below normal demand",
         "The workload has a memory leak",
         "Runtime heap settings ignore the container limit",
         "A peak of requests was held in memory",
         "Side containers use part of the pod's share"),
        ("Compare memory use with the limit over time",
         "Raise the container's memory limit",
         "Set the runtime heap to a share of the limit",
         "Profile the container's memory under load",
         "Scale out so that each pod serves less",
         "Alert when use comes near the limit")),
    "K8S_NODE_NOT_READY": Advice(
        "A cluster node stopped being ready for work.",
        "The node agent does not report, or reports a failing condition.",
        ("The kubelet or container runtime is down",
         "The node lost its network",
         "The node ran out of disk, memory or processes",
         "The node's certificate for the control plane ran out",
         "The machine was stopped or taken back by the provider",
         "The network plug-in of the node fails"),
        ("Describe the node and read its conditions",
         "Restart the kubelet or replace the node",
         "Drain the node before repair",
         "Renew the node's certificate",
         "Check the machine in the provider's console",
         "Look at the network plug-in's pods on the node")),
    "K8S_LIVENESS_FAIL": Advice(
        "A container health probe failed.",
        "The container did not answer the probe as expected.",
        ("The program hangs or answers slowly",
         "Probe path or port is wrong",
         "The probe's time limit is too short",
         "A dependency is checked by the probe and is down",
         "The container is short of processor time"),
        ("Call the probe address from inside the pod",
         "Correct path and port of the probe",
         "Allow the probe more time or more attempts",
         "Leave dependencies out of liveness checks",
         "Use a start-up probe for slow starts",
         "Raise the container's processor share")),
    "K8S_EVICTION": Advice(
        "Pods were removed from a node that is short of resources.",
        "The node passed a pressure threshold and reclaimed room.",
        ("Disk or memory on the node is nearly used up",
         "Pods request less than they use",
         "Too many pods share one node",
         "Logs or scratch files of pods fill the node",
         "A pod of higher priority needed the room"),
        ("Free or add the resource under pressure",
         "Set requests close to real use",
         "Spread pods over more nodes",
         "Limit the scratch space of each pod",
         "Give important pods a higher priority",
         "Let the cluster add nodes by itself")),
    "K8S_RBAC_DENIED": Advice(
        "The cluster refused an operation because of its access rules.",
        "No role binding allows this account to do what it tried.",
        ("The service account has no suitable role",
         "The role is bound in another namespace",
         "The verb or resource is missing from the role",
         "The pod runs under the default account",
         "A cluster-wide right is needed but a role of one namespace is bound"),
        ("Ask the cluster with kubectl auth can-i",
         "Bind a role with the needed verb to the account",
         "Check namespace and account of the pod",
         "Name a service account in the manifest",
         "Use a cluster role where the resource has no namespace")),
    "DOCKER_DAEMON_ERROR": Advice(
        "The Docker daemon is not reachable.",
        "The daemon is stopped, or its socket cannot be used.",
        ("The docker service is not running",
         "The user is not in the docker group",
         "The daemon's disk or settings are broken",
         "The client is pointed to another host or context",
         "The daemon was stopped by an update"),
        ("Look at the docker service with systemctl",
         "Allow the user to use the docker socket",
         "Read the daemon's log for its last error",
         "Check the client's context and DOCKER_HOST",
         "Start the service and enable it at boot")),
    "DOCKER_BUILD_FAIL": Advice(
        "A container image build failed.",
        "A build step ended with an error.",
        ("A file to copy is not in the build context",
         "A command in the build returned an error",
         "The base image or a package cannot be fetched",
         "The build host has no disk or memory left",
         "A build argument or secret was not passed",
         "A package version is no longer on offer"),
        ("Run the failing step by hand in the last good layer",
         "Check paths against the build context and its ignore file",
         "Build again without the cache",
         "Free disk space of the build host",
         "Pass all build arguments and secrets",
         "Pin the base image and packages to known versions")),
    "DOCKER_CONTAINER_EXIT": Advice(
        "A container stopped with an error code.",
        "The main process of the container ended with a failure.",
        ("The program failed or got a wrong argument",
         "A needed service was not there yet",
         "The container was stopped from outside",
         "The memory limit stopped the container",
         "The start command or its file is missing or not executable"),
        ("Read the log of the stopped container",
         "Look up the exit code",
         "Set a restart policy for the container",
         "Check the container's limits against its use",
         "Start a shell in the image and run the command by hand")),
    "DOCKER_NETWORK_ERROR": Advice(
        "A container network could not be used.",
        "The network does not exist or clashes with another.",
        ("The network was removed or never created",
         "Address ranges overlap",
         "A stale endpoint still carries the name",
         "Firewall rules of the daemon were flushed",
         "The container was attached to another network than its peers"),
        ("List networks and create the missing one",
         "Choose an address range of its own",
         "Disconnect the stale endpoint",
         "Restart the daemon so that it writes its rules again",
         "Attach containers that talk to each other to one network")),
    "DOCKER_VOLUME_ERROR": Advice(
        "A volume could not be mounted into a container.",
        "The source of the mount is missing or not accessible.",
        ("The host path does not exist",
         "Security labels or ownership forbid access",
         "The volume driver reports an error",
         "The path is not shared with the virtual machine of the daemon",
         "Another container holds the volume exclusively"),
        ("Create the host path or the volume first",
         "Fix ownership or labels of the source",
         "Check the volume driver's state",
         "Share the path with the daemon's virtual machine",
         "Stop the container that holds the volume")),
    "CLOUD_LAMBDA_TIMEOUT": Advice(
        "A cloud function ran into its time limit.",
        "The function did more work, or waited longer, than its limit allows.",
        ("A call inside the function is slow",
         "A cold start takes most of the time",
         "The limit is set too low",
         "The function has no route out of its private network",
         "A connection is opened anew on every call",
         "The event holds more records than usual"),
        ("Measure the calls made inside the function",
         "Give the function more time or memory",
         "Move long work to a queue or batch job",
         "Check subnets, routes and security groups",
         "Open connections outside the handler",
         "Take fewer records per event")),
    "CLOUD_LAMBDA_MEMORY": Advice(
        "A cloud function ended early, most likely for lack of memory.",
        "The function's runtime was stopped before it finished.",
        ("The memory size of the function is too small",
         "State grows from one invocation to the next",
         "The payload is larger than planned",
         "A native library or layer crashes the runtime",
         "Temporary storage of the function is full"),
        ("Compare peak memory with the configured size",
         "Raise the function's memory size",
         "Stream the payload rather than load it whole",
         "Test layers and libraries with the runtime's version",
         "Clear temporary storage or enlarge it")),
    "CLOUD_S3_ACCESS_DENIED": Advice(
        "Access to object storage failed.",
        "The bucket or object is missing, or the caller may not read it.",
        ("The bucket policy does not admit the caller",
         "Bucket or key name is wrong",
         "The object is encrypted with a key the caller cannot use",
         "A rule of the organisation forbids the access",
         "Public access is blocked for the account",
         "A pre-signed address has run out"),
        ("Check bucket policy and the caller's role together",
         "Verify bucket, region and key",
         "Allow use of the encryption key",
         "Read the access log or the audit trail of the call",
         "Use a role rather than public access",
         "Create pre-signed addresses shortly before their use")),
    "CLOUD_THROTTLING": Advice(
        "A cloud provider slowed down or refused calls.",
        "Calls exceed the provider's rate for this account or resource.",
        ("Many workers call the same interface at once",
         "Retries add to the load",
         "Provisioned capacity is too small",
         "One hot key or partition takes most of the calls",
         "Another team uses up the quota of the account"),
        ("Retry with exponential back-off and jitter",
         "Spread calls over time",
         "Raise the provisioned capacity or service quota",
         "Cache answers that rarely change",
         "Spread keys evenly over partitions",
         "Use batch calls where there are any"),
        ("Throttling lasts, so work is piling up",)),
    "CLOUD_IAM_ERROR": Advice(
        "A cloud identity or its credentials were not accepted.",
        "Keys, token or role do not authorise the call.",
        ("Access keys were rotated or deleted",
         "A temporary token ran out",
         "The role's trust policy excludes the caller",
         "The clock of the host is too far off to sign calls",
         "The program finds other credentials first",
         "A boundary or policy of the organisation takes the right away"),
        ("Ask the provider which identity is in use",
         "Renew the keys or the temporary token",
         "Correct the trust policy of the role",
         "Synchronise the host's clock",
         "Check the order in which credentials are looked up",
         "Test the call in the provider's policy simulator")),
    "MQ_CONNECTION_LOST": Advice(
        "The connection to the message broker was lost.",
        "The broker went away or closed the connection.",
        ("The broker restarted or failed over",
         "Heartbeats were missed",
         "The broker reached a resource alarm",
         "The network between client and broker was interrupted",
         "Credentials or certificate of the client ran out",
         "A load balancer closed the idle connection"),
        ("Look at the broker's health and log",
         "Reconnect automatically with a growing pause",
         "Tune heartbeat and idle limits of the broker",
         "Check the path and its idle limits",
         "Renew the client's credentials",
         "Run more than one broker so that one may fail")),
    "MQ_CONSUMER_LAG": Advice(
        "Message consumers are falling behind.",
        "Messages arrive faster than they are processed.",
        ("Each message takes longer than before",
         "Too few consumers or partitions",
         "A consumer is stuck on one message",
         "A burst of messages arrived",
         "The store that consumers write to is slow",
         "Consumers keep being reassigned"),
        ("Add consumers up to the number of partitions",
         "Speed up the handling of a message",
         "Find the consumer that makes no progress",
         "Write results in batches",
         "Look into frequent reassignments of partitions",
         "Alert on the age of the oldest message"),
        ("The lag is described as critical",)),
    "MQ_DEAD_LETTER": Advice(
        "A message could not be processed and was set aside.",
        "Handling failed so often that the message was given up.",
        ("The message's content is not what the consumer expects",
         "A service the consumer needs was down",
         "The message outlived its time to live",
         "The consumer has a defect that this message brings out",
         "The message went to a queue that nobody was meant to read"),
        ("Inspect the messages that were set aside",
         "Repair the consumer and replay them",
         "Alert when the dead letter queue is not empty",
         "Record the reason with each message set aside",
         "Check messages against a schema before they are sent",
         "Let the number of attempts grow with a pause between them")),
    "MQ_PUBLISH_FAIL": Advice(
        "A message could not be handed to the broker.",
        "The broker did not accept or confirm the message.",
        ("Topic, queue or exchange does not exist",
         "The channel was closed after an error",
         "The message is larger than allowed",
         "The publisher may not write to the topic",
         "Too few replicas are in step to confirm",
         "The broker's disk is full"),
        ("Create the topic, queue or exchange",
         "Open a new channel and publish again",
         "Store unconfirmed messages until they are accepted",
         "Grant the publisher write access",
         "Restore the replicas that are out of step",
         "Free disk space of the broker or shorten retention")),
    "CACHE_REDIS_ERROR": Advice(
        "Redis refused a connection or a command.",
        "The Redis server is down, busy, or wants other credentials.",
        ("The server is loading its data set",
         "The password is missing or wrong",
         "The client limit has been reached",
         "Memory is full and nothing may be evicted",
         "The node is a replica and refuses writes",
         "The cluster moved the slot to another node"),
        ("Ping the server with redis-cli",
         "Set the right cache password",
         "Reuse connections or raise maxclients",
         "Set a memory limit and an eviction policy",
         "Send writes to the primary",
         "Use a client that follows the cluster's redirections")),
    "CACHE_MISS_SPIKE": Advice(
        "The cache answers far fewer requests than usual.",
        "Entries are missing, so requests go to the store behind.",
        ("The cache was flushed or restarted",
         "Many entries ended at the same time",
         "Keys changed with a release",
         "Memory is short, so entries are evicted early",
         "A scan asks for many keys that do not exist"),
        ("Warm the cache before sending it traffic",
         "Vary the lifetime of entries",
         "Let one request refill an entry while others wait",
         "Give the cache more memory",
         "Remember absent keys for a short time")),
    "EMAIL_SMTP_ERROR": Advice(
        "A mail could not be delivered.",
        "The mail server refused the connection, the sender or the recipient.",
        ("The recipient address does not exist",
         "The sender's reputation or records are poor",
         "Mail server credentials are wrong",
         "The server limits the number of mails",
         "The connection is not encrypted as the server demands",
         "The mail or an attachment is too large"),
        ("Read the reply code of the mail server",
         "Check SPF, DKIM and DMARC records",
         "Verify the mail account's credentials",
         "Use the port and encryption that the server demands",
         "Queue mails and send them again later",
         "Send a link in place of a large attachment"),
        ("The lost mail matters to the user's account",)),
    "LOG_ROTATION_FAIL": Advice(
        "Log files are not being rotated.",
        "The rotation job fails, so files keep growing.",
        ("The job may not write to the log directory",
         "The rotation settings contain a mistake",
         "A process keeps the old file open",
         "The disk has no room for the rotated copy",
         "The rotation job is not scheduled any more"),
        ("Run logrotate in debug mode",
         "Fix rights of the log directory",
         "Signal the process to reopen its log",
         "Free space and rotate by hand once",
         "Check that the job is scheduled and when it last ran")),
    "NGINX_BAD_GATEWAY": Advice(
        "A reverse proxy got no valid answer from the service behind it.",
        "The upstream service closed the connection or is not there.",
        ("The upstream process crashed or restarts",
         "The proxy points to a wrong address",
         "The upstream closes idle connections early",
         "The answer's headers exceed the proxy's buffers",
         "All upstream workers are busy",
         "Proxy and upstream disagree on encryption"),
        ("Call the upstream directly from the proxy host",
         "Correct the upstream address",
         "Align keep-alive of proxy and upstream",
         "Enlarge the proxy's header buffers",
         "Add upstream workers",
         "Read the proxy's error log for the upstream's name")),
    "DB_DEADLOCK": Advice(
        "Two or more transactions blocked each other and one was rolled back.",
        "Transactions took the same locks in a different order.",
        ("Rows are updated in varying order",
         "Transactions stay open too long",
         "Missing indexes widen the locked range",
         "A foreign key check locks rows of another table",
         "Batch jobs and users change the same rows"),
        ("Touch tables and rows in one fixed order",
         "Keep transactions short",
         "Retry the transaction that was rolled back",
         "Read the engine's deadlock report",
         "Add the indexes that narrow the locks",
         "Run batch jobs in small steps")),
    "APP_STACK_OVERFLOW": Advice(
        "A program ran out of call stack.",
        "Calls nested deeper than the stack allows.",
        ("A recursion without a reachable end",
         "Objects that refer to each other in a circle",
         "Input nested more deeply than expected",
         "Two functions or hooks call each other",
         "The thread's stack is set too small"),
        ("Find the repeating frames in the stack trace",
         "Turn the recursion into a loop",
         "Bound the nesting depth of input",
         "Guard against visiting an object twice",
         "Break the cycle between the functions",
         "Enlarge the stack if the depth is justified")),
    "APP_UNHANDLED_PROMISE": Advice(
        "An asynchronous operation failed and nothing handled the failure.",
        "A rejected promise has no handler.",
        ("A missing await or catch",
         "An error thrown inside a callback",
         "A library rejects where none was expected",
         "Several promises run at once and only one is handled",
         "An event handler is asynchronous but its caller does not know"),
        ("Add a catch to the promise chain",
         "Await every asynchronous call",
         "Install a global handler that reports such failures",
         "Collect results of parallel work so that each failure is seen",
         "Turn on the linter rule for floating promises"),
        ("The failure takes the process down",)),
    "APP_TYPE_ERROR": Advice(
        "Code used a value that is absent or of the wrong type.",
        "A variable was null, undefined or not what the code expects.",
        ("A field is missing from the data",
         "A function returned nothing",
         "An interface changed without its callers",
         "Data is used before it has been loaded",
         "A method lost its object when it was passed on",
         "A library changed its return type with an update"),
        ("Find the expression named in the stack trace",
         "Check for absent values before use",
         "Let a type checker cover this code",
         "Wait for data before using it",
         "Bind methods that are passed as callbacks",
         "Read the change notes of updated libraries"),
        ("The error shows in a live system",)),
    "APP_MEMORY_LEAK": Advice(
        "Memory use keeps growing and is not given back.",
        "Objects stay referenced after their work is done.",
        ("Listeners or timers are never removed",
         "A cache has no upper bound",
         "Closures hold on to large objects",
         "Connections or files are opened and not closed",
         "A global list grows with every request",
         "A library holds on to memory"),
        ("Compare two heap snapshots taken some time apart",
         "Remove listeners when they are no longer needed",
         "Bound every cache",
         "Close connections and files in every path",
         "Run a load test and watch memory over hours",
         "Update or replace the library at fault")),
    "APP_CORS_PREFLIGHT": Advice(
        "A browser's preflight request was not accepted.",
        "The server does not answer OPTIONS requests as browsers need.",
        ("The route does not handle OPTIONS",
         "Method or header is not on the allowed list",
         "Authentication runs before the preflight answer",
         "A redirect answers the preflight request",
         "A firewall or gateway blocks OPTIONS"),
        ("Answer OPTIONS on every public route",
         "List the allowed methods and headers",
         "Exempt preflight requests from authentication",
         "Call the final address so that no redirect is needed",
         "Let OPTIONS pass the gateway")),
    "APP_TIMEZONE_ERROR": Advice(
        "A date or time could not be understood.",
        "Text and expected date format or time zone do not agree.",
        ("The text is in another date format",
         "Time zone data is missing or old",
         "An empty value was parsed as a date",
         "Summer time skips or repeats the hour",
         "Seconds were taken for milliseconds"),
        ("Exchange times in ISO 8601 with an offset",
         "Store times in UTC",
         "Check date fields before parsing",
         "Update the time zone data",
         "Test with dates around changes of the clock"),
        ("Billing or scheduling depends on the date",)),
}
