"""Line rules: a catalogue of patterns, the scan, and findings.

A rule says what a line assigns or calls, with which argument; its pattern is made from that. It is
positive AND NOT negative over one comment-stripped line, so that no pattern needs look-around and
the same text serves as SQL oracle. The scan is one projection: the texts that can
hold a match at all are picked by their whole text before any line is split off.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import reduce
from operator import or_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from corvane.functions.paths import is_production
from corvane.functions.severity import confidence_band
from corvane.functions.text import clip, is_comment_line, is_fixture_secret, is_placeholder, quoted_value, split_lines, strip_comment

from .chunking import CHUNK_LINES, covering_chunk


@dataclass(frozen=True)
class LineRule:
    rule_id: str
    category: str  # bug or security
    kind: str  # bug pattern or security category
    severity: str
    pattern: str  # found anywhere in the line, any case
    unless: str | None = None  # a line with this is left out
    secret: bool = False  # stand-in values end the rule for the chunk
    cwe: str | None = None
    cvss: float | None = None
    title: str = ""
    fix: str = ""
    needs: tuple[str, ...] = ()  # lower-case; every match holds one of them
    also: tuple[str, ...] = ()  # and one of these
    python_only: bool = False

    @property
    def confidence(self) -> float:
        return 0.75 if self.category == "security" else 0.70


# ---------------------------------------------------------------- pattern parts
def words(*options: str) -> str:
    """One of the words; a dot is a dot, a blank an underscore that may be missing."""
    return "(?:" + "|".join(x.replace(".", "[.]").replace(" ", "_?") for x in options) + ")"


def quoted(characters: str, least: int) -> str:
    """A quoted run of at least so many characters."""
    return f"[\"']{characters}{{{least},}}[\"']"


def assigned(name: str, value: str, sign: str = "=") -> str:
    return rf"{name}\s*{sign}\s*{value}"


def call(function: str, argument: str = "") -> str:
    """A call whose argument list starts as given."""
    return rf"{function}\s*\({argument}"


INSIDE = "[^)]*"  # some of an argument list
# fixed values: the words that the rules know
CREDENTIALS = ["password", "passwd", "pwd", "secret", "secret_key", "api key", "auth token", "db pass", "db password", "database pass", "database password", "private key", "access key", "app secret"]
SECRETS = ["secret", "token", "apikey", "api_key", "access_key", "auth_key", "app_key", "client_secret", "oauth_secret", "signing_key", "encryption_key"]
CONNECTIONS, DRIVERS = ["conn", "connection", "cursor", "db"], ["psycopg2", "sqlite3", "pymysql", "cx_Oracle", "pyodbc", "mysql.connector"]
SOCKETS = ["sock", "socket", "s"]
RAW_SQL = ["raw", "RawSQL", "extra"]
SUBPROCESS, COMMANDS = ["run", "call", "Popen", "check_output", "check_call"], ["system", "popen", "exec", "execv", "exece", "execp", "execve", "execvp"]
INPUTS, UPLOADS, CHECKS = ["request", "user", "input", "data", "query", "params", "getattr"], ["request", "file", "upload", "data"], ["allowlist", "whitelist", "extension", "suffix"]
WEAK_HASHES, HASH_CALLS, CIPHERS = ["hashlib.md5", "hashlib.sha1", "DigestUtils.md5", "DigestUtils.sha1"], ["MD5", "SHA1"], ["AES", "DES", "RSA", "Fernet"]
# fixed values: the public formats of private keys and of live payment, repository and chat tokens
KEY_FORMATS = ["-----BEGIN (?:RSA |EC )?PRIVATE KEY-----", "sk_live_[a-zA-Z0-9]{20,}", "ghp_[a-zA-Z0-9]{36}", "xox[baprs]-[0-9a-zA-Z]{10,}"]
_SOCKET = call("socket[.]socket", INSIDE + r"\)")
_SAVE = call("[.]save", r"\s*" + words(*UPLOADS))
# rules; their ids, severities, weakness numbers and scores are fixed values
RULES = [
    LineRule("BUG-030", "bug", "ResourceLeak", "HIGH", r"=\s*" + call("open", r"[^)]+\)"), unless=r"^\s*with\b|\bwith\b.*\bopen\b", needs=("open",), also=("=",), title="file opened outside a with block", fix="Open the file in a with block."),
    LineRule("BUG-031", "bug", "ResourceLeak", "MEDIUM", assigned(words(*CONNECTIONS), call(words(*DRIVERS) + "[.]connect")), needs=("connect",), also=("=",), title="database connection may stay open", fix="Close the connection in a finally clause or use a context manager."),
    LineRule("BUG-032", "bug", "ResourceLeak", "MEDIUM", assigned(words(*SOCKETS), _SOCKET), unless=_SOCKET + r".*with\b", needs=("socket",), also=("=",), title="socket may stay open", fix="Use the socket as a context manager."),
    LineRule("SEC-001", "security", "HardcodedSecret", "CRITICAL", assigned(words(*CREDENTIALS), quoted("[^\"']", 4)), secret=True, cwe="CWE-798", cvss=9.8, needs=("pass", "pwd", "secret", "key", "token"), also=("=",), title="credential in source", fix="Read the credential from the environment or a secret store, and change it.", python_only=True),
    LineRule("SEC-002", "security", "HardcodedSecret", "CRITICAL", "|".join(KEY_FORMATS), cwe="CWE-321", cvss=9.8, needs=("private key", "sk_live_", "ghp_", "xox"), title="private key or token in source", fix="Revoke the key and keep its successor out of the source.", python_only=True),
    LineRule("SEC-003", "security", "HardcodedSecret", "HIGH", assigned(words(*SECRETS), quoted("[A-Za-z0-9+/=_-]", 16), "[=:]"), secret=True, cwe="CWE-798", cvss=8.2, needs=("secret", "token", "key"), also=('"', "'"), title="secret-like value in source", fix="Move the value to a secret store.", python_only=True),
    LineRule("SEC-011", "security", "Injection", "HIGH", "(?:" + "|".join(rf"{x}\(" for x in RAW_SQL) + ").*(?:format|%|f[\"'])", cwe="CWE-89", cvss=8.8, needs=("raw", "extra("), also=("(",), title="raw SQL built from values", fix="Pass the values as parameters.", python_only=True),
    LineRule("SEC-020", "security", "Injection", "CRITICAL", call("subprocess[.]" + words(*SUBPROCESS), INSIDE + assigned("shell", "True")), cwe="CWE-78", cvss=9.8, needs=("subprocess",), also=("shell",), title="command through a shell", fix="Pass a list of arguments without a shell.", python_only=True),
    LineRule("SEC-021", "security", "Injection", "CRITICAL", call("os[.]" + words(*COMMANDS), INSIDE + "[+%]"), cwe="CWE-78", cvss=9.8, needs=("os.system", "os.popen", "os.exec"), also=("(",), title="command built from values", fix="Pass a list of arguments to subprocess.run.", python_only=True),
    LineRule("SEC-022", "security", "Injection", "CRITICAL", r"\b" + call(words("eval", "exec"), r"\s*" + words(*INPUTS)), cwe="CWE-95", cvss=9.8, needs=("eval", "exec"), also=("(",), title="evaluation of input", fix="Parse the input instead of evaluating it.", python_only=True),
    LineRule("SEC-031", "security", "InsecureUpload", "HIGH", _SAVE, unless=_SAVE + ".*" + words(*CHECKS), cwe="CWE-434", cvss=7.5, needs=(".save",), also=("(",), title="upload saved unchecked", fix="Check the type of the file against a list of allowed ones.", python_only=True),
    LineRule("SEC-060", "security", "WeakCryptography", "MEDIUM", f"{words(*WEAK_HASHES)}|{call(words(*HASH_CALLS))}", cwe="CWE-326", cvss=5.3, needs=("md5", "sha1"), title="weak hash", fix="Use SHA-256, or a password hash for passwords.", python_only=True),
    LineRule("SEC-061", "security", "WeakCryptography", "CRITICAL", call(words(*CIPHERS), quoted("[A-Za-z0-9+/=]", 8)), cwe="CWE-321", cvss=9.1, needs=("aes", "des", "rsa", "fernet"), also=("(",), title="key in source", fix="Read the key from a secret store.", python_only=True),
]
BY_ID = {r.rule_id: r for r in RULES}


def _holding(rows: DataFrame, rules: list[LineRule], column: str) -> DataFrame:
    """Rows whose text can match a rule: a literal that the rule needs is looked up before its pattern runs.

    The row id is not deterministic, which keeps the filter above it and the lower-casing to one.
    """
    low = rows.withColumn("_low", F.lower(column)).withColumn("_id", F.monotonically_increasing_id())
    test = F.lit(False)
    for r in rules:
        here = F.lit(True)
        for words in (r.also, r.needs):
            if words:
                here = here & reduce(or_, (F.contains("_low", F.lit(x)) for x in words))
        test = test | (here & F.col(column).rlike(f"(?i){r.pattern}"))
    return low.filter(test).drop("_low", "_id")


def scan_lines(files: DataFrame, rules: list[LineRule] | None = None, production_only: bool = True, python_gate: bool = True, docstrings: Column | None = None) -> DataFrame:
    """rule_hit rows of files(file_path, language, content, ...): the first hit of each rule in each line window.

    Columns: all of files but content, rule_id, chunk_no, line_no, match_text, value. Comment lines
    and lines in docstrings (an array<int> of 0-based line numbers, if given) are left out; inline
    comments are cut off. For a secret rule whose first match is a stand-in, the window has no hit.
    """
    rules = RULES if rules is None else rules
    keep = [c for c in files.columns if c != "content"]
    if production_only:
        files = files.filter(is_production(F.col("file_path")))
    files = _holding(files, rules, "content")
    rows = files.select(*keep, *([docstrings.alias("_doc")] if docstrings is not None else []), F.posexplode(split_lines(F.col("content"))).alias("_i", "_raw"))
    if docstrings is not None:
        rows = rows.filter(~F.array_contains("_doc", F.col("_i"))).drop("_doc")
    rows = _holding(rows, rules, "_raw").filter(~is_comment_line(F.col("_raw"))).withColumn("_line", strip_comment(F.col("_raw")))

    def hit(r: LineRule) -> Column:
        test = F.col("_line").rlike(f"(?i){r.pattern}")
        if r.unless:
            test = test & ~F.col("_line").rlike(f"(?i){r.unless}")
        if r.python_only and python_gate:
            test = test & (F.col("language") == "python")
        return F.when(test, F.struct(F.lit(r.rule_id).alias("rule_id"), F.lit(r.secret).alias("secret"), F.regexp_extract("_line", f"(?i){r.pattern}", 0).alias("m")))

    hits = rows.select(*keep, (F.col("_i") + 1).alias("line_no"), F.explode(F.filter(F.array(*map(hit, rules)), lambda h: h.isNotNull())).alias("h"))
    hits = hits.select(*keep, "line_no", "h.rule_id", "h.secret", F.col("h.m").alias("m")).withColumn("chunk_no", covering_chunk(F.col("line_no"), CHUNK_LINES))
    w = Window.partitionBy(*[c for c in keep if c in ("repo_id", "doc_id", "file_path")], "rule_id", "chunk_no").orderBy("line_no")
    first = hits.withColumn("_rn", F.row_number().over(w)).filter("_rn = 1").withColumn("value", quoted_value(F.col("m")))
    first = first.filter(~F.col("secret") | ~(is_placeholder(F.col("value")) | is_fixture_secret(F.col("value"))))
    return first.select(*keep, "rule_id", "chunk_no", "line_no", clip(F.col("m"), 120).alias("match_text"), "value")


def rule_table(spark, rules: list[LineRule] | None = None) -> DataFrame:
    """The rules as a dimension table."""
    rows = [(r.rule_id, r.category, r.kind, r.severity, r.confidence, r.cwe, r.cvss, r.title, r.fix) for r in (rules or RULES)]
    return spark.createDataFrame(rows, "rule_id string, category string, kind string, severity string, confidence double, cwe string, cvss double, title string, suggested_fix string")


def to_findings(hits: DataFrame, rules: DataFrame) -> DataFrame:
    """Findings of hits: the rule's fields, a description, a title of at most 200 characters, the confidence band."""
    joined = hits.join(F.broadcast(rules), "rule_id").withColumn("label", F.col("title"))
    joined = joined.withColumn("description", F.format_string("%s in line %d: %s", "label", "line_no", "match_text"))
    title = clip(F.format_string("[%s] %s: %s", "rule_id", "title", "file_path"), 200)
    return joined.withColumn("title", title).withColumn("confidence_level", confidence_band(F.col("confidence"))).withColumn("start_line", F.col("line_no")).withColumn("end_line", F.col("line_no"))
