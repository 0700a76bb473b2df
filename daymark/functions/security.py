"""Normalisation rules of the five log formats, as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

# Words that stand for a missing name.
NULL_WORDS = ["nan", "none", "null"]

# Activity words of the web-company logs and the canonical actions.
SESSION_DEVICE_ACTIONS = {
    "Logon": "logon", "Logoff": "logoff", "Connect": "usb_connect", "Disconnect": "usb_disconnect",
}
FILE_ACTIONS = {
    "File Open": "file_read", "File Copy": "file_write", "File Write": "file_write", "File Delete": "file_delete",
}
EMAIL_ACTIONS = {"Send": "email_send", "View": "email_recv", "Receive": "email_recv"}

# Authentication orientations.
AUTH_ORIENTATIONS = {"LogOn": "logon", "LogOff": "logoff"}

# Windows service accounts.
SERVICE_ACCOUNTS = [
    "SYSTEM", "LOCAL SERVICE", "NETWORK SERVICE", "ANONYMOUS LOGON", "LOCAL SYSTEM", "SERVICE",
    "DWM-1", "DWM-2", "UMFD-0", "UMFD-1",
]

# Host telemetry object/action and the canonical action.
HOST_ACTIONS = {
    "FILE/CREATE": "file_write", "FILE/WRITE": "file_write", "FILE/MODIFY": "file_write", "FILE/RENAME": "file_write",
    "FILE/READ": "file_read", "FILE/DELETE": "file_delete",
    "PROCESS/CREATE": "process_start", "PROCESS/OPEN": "process_start", "SHELL/COMMAND": "cmd_exec",
    "USER_SESSION/LOGIN": "logon", "USER_SESSION/INTERACTIVE": "logon", "USER_SESSION/REMOTE": "logon", "USER_SESSION/RDP": "logon",
    "USER_SESSION/UNLOCK": "logon", "USER_SESSION/GRANT": "logon", "USER_SESSION/LOGOUT": "logoff",
    "FLOW/START": "http", "FLOW/MESSAGE": "http", "FLOW/OPEN": "http",
}
SESSION_LOGONS = ["LOGIN", "INTERACTIVE", "REMOTE", "RDP", "UNLOCK", "GRANT"]
PORT_ACTIONS = {22: "ssh", 21: "ftp", 80: "http", 443: "http", 8080: "http", 8443: "http"}

# Which property names the thing touched, by object type, in order of preference.
OBJECT_PROPERTIES = {
    "FILE": ["file_path", "new_path", "image_path"],
    "PROCESS": ["command_line", "image_path"],
    "SHELL": ["payload", "command_line", "image_path"],
    "FLOW": ["dest_ip", "src_ip", "image_path"],
    "MODULE": ["module_path", "image_path"],
    "REGISTRY": ["key", "value", "image_path"],
    "TASK": ["task_name", "path", "image_path"],
    "SERVICE": ["name", "image_path"],
    "USER_SESSION": ["requesting_user", "logon_id", "image_path"],
}
OTHER_PROPERTIES = ["image_path", "command_line", "file_path"]

OBJECT_LENGTH = 120


def lookup(values: dict, key: Column) -> Column:
    """Value of a small fixed map, null when absent."""
    return F.element_at(F.create_map(*[F.lit(x) for kv in values.items() for x in kv]), key)


def filled(text: Column) -> Column:
    """Trimmed text, null when empty."""
    return F.nullif(F.trim(text), F.lit(""))


def mapped_action(activity: Column, values: dict[str, str], fallback: str) -> Column:
    return F.coalesce(lookup(values, activity), F.lit(fallback))


def before_at(account: Column) -> Column:
    return F.substring_index(account, "@", 1)


def is_machine_account(user: Column) -> Column:
    """Computer accounts: a trailing dollar sign, or C followed by digits only."""
    return user.endswith("$") | user.rlike(r"^C\d+$")


def norm_host(host: Column) -> Column:
    """Host name without its domain; empty for missing ones."""
    s = F.trim(F.coalesce(host, F.lit("")))
    return F.when(F.lower(s).isin(NULL_WORDS), "").otherwise(F.substring_index(s, ".", 1))


def bare_user(raw: Column) -> Column:
    """Account without domain, from ``DOMAIN\\user`` or ``user@domain``; empty for missing ones."""
    s = F.trim(F.coalesce(raw, F.lit("")))
    name = F.when(s.contains("\\"), F.element_at(F.split(s, r"\\"), -1)).otherwise(F.substring_index(s, "@", 1))
    return F.when(F.lower(s).isin([*NULL_WORDS, "unknown"]), "").otherwise(F.trim(name))


def is_service_account(raw: Column) -> Column:
    s = F.upper(F.trim(F.coalesce(raw, F.lit(""))))
    bare = bare_user(raw)
    return s.startswith("NT AUTHORITY\\") | (bare == "") | F.upper(bare).isin(SERVICE_ACCOUNTS) | bare.endswith("$")


def first_principal(candidates: Column, keep_service: bool = False) -> Column:
    """First entry of an array that names somebody (and no service account); empty if none does."""
    good = lambda c: (bare_user(c) != "") if keep_service else ~is_service_account(c)
    found = F.filter(F.filter(candidates, lambda c: c.isNotNull()), good)
    return F.coalesce(F.get(F.transform(found, bare_user), F.lit(0)), F.lit(""))


def host_action(obj: Column, act: Column, port: Column) -> Column:
    """Canonical action of (object, action), refined by the destination port for network flows."""
    o, a = F.upper(F.trim(F.coalesce(obj, F.lit("")))), F.upper(F.trim(F.coalesce(act, F.lit(""))))
    by_port = F.when(o == "FLOW", lookup(PORT_ACTIONS, port.try_cast("int")))
    return F.coalesce(by_port, lookup(HOST_ACTIONS, F.concat_ws("/", o, a)), F.lit("unknown"))


def object_text(obj: Column, props: Column) -> Column:
    """First non-empty property of the object type's list, cut to 120 characters."""
    o = F.upper(F.trim(F.coalesce(obj, F.lit(""))))
    first = lambda names: F.coalesce(*[filled(F.element_at(props, n)) for n in names])
    chain = F.lit(None).cast("string")
    for name, keys in OBJECT_PROPERTIES.items():
        chain = F.when(o == name, first(keys)) if name == "FILE" else chain.when(o == name, first(keys))
    return F.coalesce(F.substring(chain.otherwise(first(OTHER_PROPERTIES)), 1, OBJECT_LENGTH), F.lit("unknown"))


def target_host(host: Column, obj: Column, props: Column) -> Column:
    """Remote address of a network flow by its direction; the host itself for anything else."""
    own = F.coalesce(filled(host), F.lit("unknown"))
    src, dest = filled(F.element_at(props, "src_ip")), filled(F.element_at(props, "dest_ip"))
    way = F.lower(F.trim(F.coalesce(F.element_at(props, "direction"), F.lit(""))))
    remote = F.when((way == "inbound") & src.isNotNull(), src).otherwise(F.coalesce(dest, src))
    return F.when(F.upper(F.trim(F.coalesce(obj, F.lit("")))) == "FLOW", F.coalesce(remote, own)).otherwise(own)


# ---- the exercise log -----------------------------------------------------------------------------

# Graded phrases from a threshold upwards.
GRADES = {"lowly": ["Highly", "Midly", "Lowly"], "midly": ["Highly", "Midly"], "highly": ["Highly"]}


def exercise_action(activity: Column, action: Column) -> Column:
    """Canonical action from the activity word and substrings of the action text."""
    a, t = F.lower(F.coalesce(activity, F.lit("nan"))), F.lower(F.coalesce(action, F.lit("nan")))
    session = F.when(t.contains("logoff"), "logoff").when(t.contains("fail"), "auth").otherwise("logon")
    file = (
        F.when(t.contains("modif") | t.contains("added"), "file_write")
        .when(t.contains("delet"), "file_delete")
        .otherwise("file_read")
    )
    device = F.when(t.contains("disconnect"), "usb_disconnect").otherwise("usb_connect")
    return (
        F.when(a == "command", "cmd_exec")
        .when(a == "http", "http")
        .when(a == "email", "email_send")
        .when(a == "session", session)
        .when(a == "file", file)
        .when(a == "device", device)
        .otherwise("unknown")
    )


def exercise_label(description: Column, level: Column, threshold: str = "midly") -> Column:
    """1 for a graded phrase from the threshold, or a numeric level from 8."""
    phrase = "|".join(f"{g} Suspicious" for g in GRADES[threshold])
    graded = F.coalesce(description, F.lit("")).rlike(f"(?i){phrase}")
    return (graded | (F.coalesce(F.trim(level).try_cast("double"), F.lit(0.0)) >= 8)).cast("int")
