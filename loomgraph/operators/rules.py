"""Rule scans: secrets, line rules, graph diagnosis, drift, policy. Findings are flat rows of one shape."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from loomgraph.operators import checks

#: Folders, names and extensions of files that hold credentials.
SECRET_DIRS = [".ssh", ".gnupg", ".aws", ".azure", ".kube", "secrets", "secret"]
SECRET_NAMES = [".env", ".envrc", ".npmrc", ".pypirc", ".netrc", "_netrc", ".htpasswd", "credentials", "credentials.json", "credentials.toml", "credentials.yml", "id_rsa", "id_dsa", "id_ecdsa", "id_ed25519", "kubeconfig", ".dockercfg"]
SECRET_EXTENSIONS = ["pem", "key", "p8", "p12", "pfx", "keystore", "jks", "kdbx", "ppk", "gpg", "pgp", "tfstate", "tfvars"]
#: Prefixes of provider tokens and the least number of signs that follow.
TOKEN_PREFIXES = [("AKIA", 16), ("ASIA", 16), ("ghp_", 36), ("gho_", 36), ("ghs_", 36), ("ghr_", 36), ("xoxb-", 10), ("xoxp-", 10), ("sk-", 20)]
SECRET_TEXT = "-----BEGIN [A-Z0-9 ]*(PRIVATE KEY|PGP PRIVATE KEY BLOCK)-----|" + "|".join(f"{p}[A-Za-z0-9_-]{{{n},}}" for p, n in TOKEN_PREFIXES)
#: Extensions that are indexed.
INDEXED = ["adoc", "md", "txt", "rst", "csv", "html", "rs", "py", "go", "ts", "tsx", "js", "jsx", "java", "kt", "cs", "c", "h", "cpp", "hpp", "rb", "php"]

#: Line rules by weakness of the public CWE list: (rule, languages or None for all, category, severity, pattern).
#: Patterns have no look-around, so any regular-expression engine reads them alike.
LINE_RULES: list[tuple[str, list[str] | None, str, str, str]] = [
    ("cwe-22-parent-path", None, "path", "high", r"\bopen\w*\s*\([^)]*\.\./"),
    ("cwe-78-shell", ["py", "java"], "injection", "critical", r"\bshell\s*=\s*True\b|\bos\.popen\s*\(|\bgetRuntime\(\)\.exec\b"),
    ("cwe-79-raw-markup", ["js", "ts", "html"], "injection", "high", r"\.(inner|outer)HTML\s*=|\bdocument\.writeln?\s*\("),
    ("cwe-89-built-query", None, "injection", "high", r"\b(execute|executemany|rawQuery)\s*\(\s*(f[\"']|[\"'][^\"']*[\"']\s*[%+])"),
    ("cwe-95-evaluated-text", ["py", "js", "ts"], "injection", "critical", r"\b(eval|execfile)\s*\(\s*[A-Za-z_]"),
    ("cwe-295-unchecked-certificate", None, "transport", "high", r"\bverify\s*=\s*False\b|\bInsecureSkipVerify\s*:\s*true\b|\brejectUnauthorized\s*:\s*false\b"),
    ("cwe-319-plain-http", None, "transport", "low", r"[\"'(]http://[A-Za-z0-9.-]+\.[a-z]{2,}"),
    ("cwe-327-weak-digest", None, "cryptography", "medium", r"\bhashlib\.(md4|md5|sha1)\b|\bgetInstance\(\s*\"(MD5|SHA-?1|DES)\b"),
    ("cwe-338-guessable-number", ["js", "ts", "py"], "cryptography", "low", r"\bMath\.random\(\)|\brandom\.(random|randint|choice)\("),
    ("cwe-377-shared-temporary-name", ["py", "c", "cpp"], "files", "medium", r"\b(mktemp|tmpnam|tempnam)\s*\("),
    ("cwe-390-ignored-error", ["py"], "errors", "low", r"^\s*except\b[^:]*:\s*(pass|\.\.\.)\s*$"),
    ("cwe-489-left-in", None, "debugging", "low", r"\b(breakpoint|set_trace)\s*\(|\bdebugger\s*;|\btrack\s*\(0\)"),
    ("cwe-502-foreign-objects", None, "injection", "critical", r"\b(pickle|marshal|dill)\.loads?\s*\(|\bunserialize\s*\(|\bnew\s+ObjectInputStream\b"),
    ("cwe-732-open-to-all", None, "files", "medium", r"\bchmod\b[^\n]*\b0?777\b"),
    ("cwe-798-credential", None, "credentials", "critical", SECRET_TEXT),
    ("cwe-798-written-password", None, "credentials", "high", r"\b(password|passphrase|client_secret)\b\s*[:=]\s*[\"'][^\"'\s]{6,}[\"']"),
    ("style-long-line", None, "style", "low", r"^.{400}"),
    ("style-open-task", None, "style", "low", r"\b(TODO|FIXME|HACK)\b"),
    ("style-trailing-blank", None, "style", "low", r"[ \t]+$"),
    ("style-mixed-blanks", None, "style", "low", r" \t|\t "),
]

#: What an issue costs, and how much a drift counts.
SEVERITY_WEIGHT = {"error": 5.0, "warning": 1.0, "info": 0.0}
DRIFT_WEIGHT = {"critical": 0.3, "high": 0.2, "medium": 0.1, "low": 0.05}
#: Prefixes and names of anchors that need no edges.
METADATA_PREFIXES = ["adr-", "plan-", "use-case-", "agent-", "mod-"]
METADATA_NAMES = ["readme", "agents", "changelog", "contributing", "security", "notice", "issues", "cla", "license"]


def extension(path: Column) -> Column:
    return F.lower(F.regexp_extract(path, r"\.([A-Za-z0-9]+)$", 1))


def is_secret_path(path: Column) -> Column:
    parts = F.split(F.regexp_replace(path, r"\\", "/"), "/")
    name = F.lower(F.element_at(parts, -1))
    service = name.startswith("service-account") & name.endswith(".json")
    return F.arrays_overlap(parts, F.array(*map(F.lit, SECRET_DIRS))) | name.isin(SECRET_NAMES) | name.startswith(".env.") | service | extension(path).isin(SECRET_EXTENSIONS)


def has_secret(text: Column) -> Column:
    return text.rlike(SECRET_TEXT)


def disposition(path: Column, text: Column) -> Column:
    """indexed, secret, unsupported or empty."""
    return F.when(is_secret_path(path) | has_secret(text), "secret").when(~extension(path).isin(INDEXED), "unsupported").when(F.length(F.trim(text)) == 0, "empty").otherwise("indexed")


def line_findings(lines: DataFrame, language: Column | None = None) -> DataFrame:
    """``lines`` (text, ...) once for every rule that fits: rule, category, severity. All rules are tested in one
    pass over a line; nothing is joined or shuffled."""
    lang = F.lit(None).cast("string") if language is None else language
    tests = [F.when(F.col("text").rlike(p) & (F.lit(True) if ls is None else F.coalesce(lang.isin(ls), F.lit(language is None))), F.struct(F.lit(r).alias("rule"), F.lit(c).alias("category"), F.lit(s).alias("severity"))) for r, ls, c, s, p in LINE_RULES]
    return lines.withColumn("f", F.explode(F.filter(F.array(*tests), lambda x: x.isNotNull()))).select(*lines.columns, "f.*")


def expected_metadata(anchor: Column) -> Column:
    return reduce(lambda a, p: a | anchor.startswith(p), METADATA_PREFIXES, F.lower(anchor).isin(METADATA_NAMES))


def orphans(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(anchor, node_type) of nodes without any edge."""
    # An anti join would be pushed into every table the nodes come from; an outer one is made once. Distinct ends are
    # combined by hash before they are shuffled, which lists of them are not.
    ends = edges.select(F.explode(F.array("src", "dst")).alias("anchor")).distinct().withColumn("met", F.lit(True))
    return nodes.select("anchor", "node_type").join(ends, "anchor", "left").where("met is null").drop("met")


def unresolved(refs: DataFrame, nodes: DataFrame) -> DataFrame:
    """Rows of refs (src, target) whose target is no node."""
    return refs.join(nodes.select(F.col("anchor").alias("target")), "target", "left_anti").select("src", "target")


def dead_code(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """Functions and types that nothing points to, metadata and main aside; containment does not count."""
    into = edges.where(~F.col("edge_type").isin("Contains", "PartOf")).select(F.col("dst").alias("anchor")).distinct()
    return nodes.where(F.col("node_type").isin("Function", "Type") & ~expected_metadata(F.col("anchor")) & ~F.col("anchor").rlike(r"(^|[#/:])main$")).join(into, "anchor", "left_anti")


def edge_violations(nodes: DataFrame, edges: DataFrame, kinds: list[str], protected: list[str]) -> DataFrame:
    """Edges of ``kinds`` that touch a node of a protected type."""
    bad = nodes.where(F.col("node_type").isin(protected)).select("anchor")
    e = edges.where(F.col("edge_type").isin(kinds))
    a = e.join(bad.select(F.col("anchor").alias("src")), "src", "left_semi")
    b = e.join(bad.select(F.col("anchor").alias("dst")), "dst", "left_semi")
    return a.select("src", "dst", "edge_type").unionByName(b.select("src", "dst", "edge_type")).distinct()


def diagnose(nodes: DataFrame, edges: DataFrame, refs: DataFrame, confidence: DataFrame | None = None, custom: dict[str, DataFrame] | None = None) -> DataFrame:
    """(category, severity, anchor): all graph scans in one table, and ``custom`` checks (registered name: its table)."""
    c = F.col("anchor")

    def issue(df: DataFrame, category: str, severity: Column) -> DataFrame:
        return df.select(F.lit(category).alias("category"), severity.alias("severity"), "anchor")
    out = [
        issue(unresolved(refs, nodes).select(F.col("src").alias("anchor")), "unresolved_ref", F.lit("error")),
        issue(nodes.groupBy("anchor").count().where("count > 1"), "duplicate_anchor", F.lit("error")),
        issue(orphans(nodes, edges), "orphan", F.when(expected_metadata(c), "info").otherwise("warning")),
    ]
    if confidence is not None:
        low = confidence.where("confidence < 0.5").join(nodes, "anchor")
        out.append(issue(low, "low_confidence", F.when(F.col("node_type").isin("Function", "Type", "Module"), "warning").otherwise("info")))
    out += [checks.run_check(name, table) for name, table in (custom or {}).items()]
    return reduce(lambda a, b: a.unionByName(b), out)


def diagnosis_score(issues: DataFrame) -> DataFrame:
    """(errors, warnings, infos, score): 100 less 5 an error and 1 a warning, within 0 and 100."""
    n = {s: F.count_if(F.col("severity") == s) for s in SEVERITY_WEIGHT}
    lost = reduce(lambda a, s: a + n[s] * SEVERITY_WEIGHT[s], SEVERITY_WEIGHT, F.lit(0.0))
    return issues.agg(n["error"].alias("errors"), n["warning"].alias("warnings"), n["info"].alias("infos"), F.greatest(F.lit(0.0), F.least(F.lit(100.0), 100 - lost)).alias("score"))


def drift(stored: DataFrame, current: DataFrame) -> DataFrame:
    """(anchor, kind, severity) of (anchor, hash) then and now: stale_hash, missing or orphan."""
    both = stored.select("anchor", F.col("hash").alias("old")).join(current.select("anchor", F.col("hash").alias("new")), "anchor", "full")
    kind = F.when(F.col("old").isNull(), "missing").when(F.col("new").isNull(), "orphan").when(F.col("old") != F.col("new"), "stale_hash")
    severity = F.when(F.col("kind") == "stale_hash", "high").when(F.col("kind") == "missing", "medium").otherwise("low")
    return both.select("anchor", kind.alias("kind")).where("kind is not null").withColumn("severity", severity)


def risk(n: Column) -> Column:
    return F.when(n == 0, "none").when(n <= 5, "low").when(n <= 20, "medium").otherwise("high")


def policy_decision(requests: DataFrame, directives: DataFrame) -> DataFrame:
    """(request_id, effect): of the directives (kind, precedence, effect) of a request's (request_id, kind) the
    one with the lowest precedence number, ties to the smallest effect; none allows."""
    best = directives.groupBy("kind").agg(F.min_by("effect", F.struct("precedence", "effect")).alias("effect"))
    return requests.join(best, "kind", "left").select("request_id", F.coalesce("effect", F.lit("allow")).alias("effect"))


def vulnerable(deps: DataFrame, rules: DataFrame) -> DataFrame:
    """deps (ecosystem, name, version) below the first good (major, minor) of a rule."""
    v = F.split("version", r"\.")
    n = F.try_element_at(v, F.lit(1)).try_cast("int") * 1000 + F.coalesce(F.try_element_at(v, F.lit(2)).try_cast("int"), F.lit(0))
    return deps.withColumn("_n", n).withColumn("_name", F.lower("name")).join(rules.select("ecosystem", F.col("name").alias("_name"), (F.col("major") * 1000 + F.col("minor")).alias("_good")), ["ecosystem", "_name"]).where("_n < _good").drop("_n", "_good", "_name")
