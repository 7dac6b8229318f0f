"""Deterministic signatures over canonical path and body.

The whole catalogue becomes one array expression, so scanning is a projection:
no join, no explode, and every pattern is a literal that is compiled once.
"""
from __future__ import annotations

import json
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from reqlens.functions import literals

BLOCK, FLAG = "block", "flag"
PATH, BODY, ANY = "path", "body", "any"

# Case-insensitive, Unicode classes, "\n" as the only line terminator.
REGEX_FLAGS = "(?idU)"

HIT_TYPE = "array<struct<id:string,category:string,severity:string,why:string>>"
_KNOWN = ("array<struct<at:int,hit:struct<id:string,category:string,severity:string,why:string>,"
          "target:string,pattern:string>>")


@dataclass(frozen=True)
class Rule:
    id: str
    category: str
    severity: str
    target: str
    pattern: str
    why: str


# The signature catalogue (id, category, severity, target, pattern,
# explanation), in evaluation order.
CATALOGUE: list[Rule] = [Rule(*row) for row in [
    ("sqli.union", "sqli", BLOCK, ANY,
     r"\bunion\b[\s/*]+(?:all[\s/*]+)?\bselect\b",
     "UNION SELECT is never emitted by a legitimate API client"),
    ("sqli.tautology", "sqli", BLOCK, ANY,
     r"['\"\s(]\s*(?:or|and)\s+['\"]?[\w]+['\"]?\s*=\s*['\"]?[\w]+['\"]?\s*(?:--|#|/\*|$|\))",
     "boolean tautology terminated by a comment or paren (' OR '1'='1' --)"),
    ("sqli.stacked_ddl", "sqli", BLOCK, ANY,
     r";\s*(?:drop|truncate|alter|create)\s+(?:table|database|schema)\b",
     "stacked DDL statement"),
    ("sqli.stacked_dml", "sqli", BLOCK, ANY,
     r";\s*(?:update|insert\s+into|delete\s+from)\s+\w+",
     "stacked DML statement"),
    ("sqli.xp_cmdshell", "sqli", BLOCK, ANY,
     r"\b(?:xp_cmdshell|sp_executesql|utl_http|dbms_lock)\b",
     "database command-execution primitive"),
    ("sqli.timing", "sqli", BLOCK, ANY,
     r"\b(?:sleep|pg_sleep|benchmark|waitfor\s+delay)\s*\(",
     "time-based blind SQLi probe"),
    ("sqli.schema", "sqli", BLOCK, ANY,
     r"\b(?:information_schema|sysobjects|pg_catalog|mysql\.user)\b",
     "database metadata enumeration"),
    ("sqli.comment_terminator", "sqli", FLAG, ANY,
     r"'\s*(?:--|#|/\*)",
     "quote immediately followed by a comment token"),
    ("xss.script_tag", "xss", BLOCK, ANY,
     r"<\s*script[\s/>]",
     "inline <script> tag"),
    ("xss.event_handler", "xss", BLOCK, ANY,
     r"<[^>]{0,64}\bon(?:error|load|click|mouseover|focus|animationstart)\s*=",
     "HTML tag carrying a JS event handler"),
    ("xss.js_uri", "xss", BLOCK, ANY,
     r"(?:javascript|vbscript|data)\s*:\s*(?:[^,\s]*script|alert|eval|document)",
     "script-bearing URI scheme"),
    ("xss.dom_exfil", "xss", BLOCK, ANY,
     r"document\s*\.\s*(?:cookie|location|write)\b",
     "DOM property used for exfiltration"),
    ("xss.svg_iframe", "xss", BLOCK, ANY,
     r"<\s*(?:svg|iframe|object|embed|body)\b[^>]{0,64}\bon\w+\s*=",
     "vector tag with event handler"),
    ("traversal.dotdot", "traversal", BLOCK, PATH,
     r"(?:^|[/\\])\.{2,}[/\\]",
     "parent-directory escape (covers ../, ..\\, ....//)"),
    ("traversal.semicolon", "traversal", BLOCK, PATH,
     r"\.\.\s*;\s*[/\\]",
     "..;/ path-parameter traversal bypass"),
    ("traversal.unix_secrets", "traversal", BLOCK, ANY,
     r"/(?:etc/(?:passwd|shadow|hosts|group)|proc/self/(?:environ|cmdline))\b",
     "read of a well-known sensitive UNIX file"),
    ("traversal.win_secrets", "traversal", BLOCK, ANY,
     r"(?:boot\.ini|windows[/\\]system32[/\\]config[/\\]sam|win\.ini)\b",
     "read of a well-known sensitive Windows file"),
    ("cmdi.chained", "cmdi", BLOCK, ANY,
     r"[;|&`]\s*(?:cat|ls|dir|whoami|id|uname|curl|wget|nc|ncat|bash|sh|python|perl|powershell|cmd)\b",
     "shell metacharacter chained into a command"),
    ("cmdi.substitution", "cmdi", BLOCK, ANY,
     r"\$\(\s*\w+|`\s*\w+\s*`",
     "shell command substitution"),
    ("cmdi.reverse_shell", "cmdi", BLOCK, ANY,
     r"(?:/dev/tcp/|bash\s+-i|nc\s+-e|mkfifo)\b",
     "reverse-shell primitive"),
    ("ssti.expr", "ssti", FLAG, ANY,
     r"\{\{[^}]{1,64}\}\}|\$\{[^}]{1,64}\}|<%=[^%]{1,64}%>",
     "template expression delimiters in user input"),
    ("scan.vcs_secrets", "scan", BLOCK, PATH,
     r"/(?:\.env|\.git|\.svn|\.hg|\.aws|\.ssh|id_rsa|\.htpasswd)(?:$|[/?])",
     "request for a version-control or credential artifact"),
    ("scan.admin_panels", "scan", FLAG, PATH,
     r"/(?:wp-admin|wp-login|phpmyadmin|adminer|pma|cgi-bin|server-status)\b",
     "probe for a well-known admin panel"),
    ("scan.config_files", "scan", FLAG, PATH,
     r"/(?:config\.(?:php|json|yml|yaml)|web\.config|\.htaccess|dump\.sql|backup\.zip)(?:$|[/?])",
     "probe for a config or backup artifact"),
    ("deser.java", "deser", BLOCK, BODY,
     r"(?:rO0AB|aced0005|__reduce__|pickle\.loads|ObjectInputStream)",
     "serialized-object payload marker"),
    ("ssrf.metadata", "ssrf", BLOCK, ANY,
     r"(?:169\.254\.169\.254|metadata\.google\.internal|metadata\.azure\.com)",
     "cloud instance-metadata endpoint (SSRF credential theft)"),
]]

BLOCK_IDS = [r.id for r in CATALOGUE if r.severity == BLOCK]


def _c(col) -> Column:
    return F.col(col) if isinstance(col, str) else col


def _subjects(path, body) -> dict[str, Column]:
    path, body = F.coalesce(_c(path), F.lit("")), F.coalesce(_c(body), F.lit(""))
    return {PATH: path, BODY: body, ANY: F.concat(path, F.lit("\n"), body)}


def _read(subject: dict[str, Column]) -> Column:
    """Texts and their folded forms as one value, so that each is made once for all rules."""
    return F.struct(*[c.alias(t) for t, c in subject.items()],
                    *[literals.folded_text(c).alias(f"{t}_folded") for t, c in subject.items()])


def _fires(rule: Rule, read: Column) -> Column:
    """The pattern is tried on texts only that hold the literals which each match of it holds."""
    text = read[rule.target]
    tried = F.rlike(text, F.lit(REGEX_FLAGS + rule.pattern))
    may = literals.may_match(read[f"{rule.target}_folded"], rule.pattern)
    return (text != "") & (tried if may is None else may & tried)


def _found(read: Column, hits: Sequence[tuple[Rule, Column]]) -> Column:
    def of(read: Column) -> Column:
        return F.filter(F.array(*[F.when(_fires(rule, read), hit) for rule, hit in hits]), lambda h: h.isNotNull())
    return F.get(F.transform(F.array(read), of), F.lit(0))


def _hit(rule: Rule) -> Column:
    return F.struct(*[F.lit(getattr(rule, k)).alias(k) for k in ("id", "category", "severity", "why")])


def scan(path="canon_path", body="canon_body", rules: Sequence[Rule] = tuple(CATALOGUE)) -> Column:
    """Hits in catalogue order. An empty subject never matches."""
    if not rules:
        return F.array().cast(HIT_TYPE)
    return _found(_read(_subjects(path, body)), [(rule, _hit(rule)) for rule in rules])


def rules_table(spark) -> DataFrame:
    """The catalogue as a table, `ordinal` giving evaluation order."""
    return spark.createDataFrame(
        [(i, r.id, r.category, r.severity, r.target, r.pattern, r.why)
         for i, r in enumerate(CATALOGUE)],
        "ordinal int, id string, category string, severity string, target string, "
        "pattern string, why string")


def scan_table(df: DataFrame, rules: DataFrame, path="canon_path", body="canon_body",
               chunk: int = 200, max_bytes: int = 16 << 20) -> DataFrame:
    """Scan with a user-supplied rule table; adds `hits`.

    Rules are operator configuration, so they come to the driver and turn into
    literal patterns; a table beyond max_bytes is refused before it is read there. A join
    on RLIKE would pair every request with every rule and recompile a pattern per pair.

    A rule whose pattern has required literals is tried only on texts that hold one of
    them: one automaton finds the literals of all rules in one pass over the text, and the
    rules it names are looked up in one constant. So neither the plan nor the work on a
    text grows with such rules. Rules without such literals are tried on every text, each
    an expression, in chunks of columns.
    """
    size = sum((F.coalesce(F.octet_length(F.col(c).cast("string")), F.lit(0)) for c in rules.columns), F.lit(0))
    total = rules.agg(F.sum(size.cast("long"))).first()[0] or 0
    if total > max_bytes:
        raise ValueError(f"a rule table of {total} bytes, more than max_bytes = {max_bytes}")
    rows = rules.orderBy("ordinal").collect()
    parsed = [Rule(r.id, r.category, r.severity, r.target, r.pattern, r.why) for r in rows]
    needs = [literals.required(r.pattern) for r in parsed]
    subject = _subjects(path, body)
    pieces = []
    gated = [(k, words) for k, words in enumerate(needs) if words]
    if gated:
        df = df.withColumn("_candidates", literals.holders(list(enumerate(w for _, w in gated)))(subject[ANY]))
        table = json.dumps([{"at": k, "hit": vars(parsed[k]), "target": parsed[k].target,
                             "pattern": REGEX_FLAGS + parsed[k].pattern} for k, _ in gated])
        known = F.from_json(F.lit(table), _KNOWN)

        def fires(rule: Column) -> Column:
            text = F.when(rule["target"] == PATH, subject[PATH]).when(
                rule["target"] == BODY, subject[BODY]).otherwise(subject[ANY])
            return (text != "") & F.rlike(text, rule["pattern"])
        hits = F.filter(F.transform("_candidates", lambda k: F.get(known, k)), fires)
        df = df.withColumn("_gated", F.transform(hits, lambda r: F.struct(r["at"].alias("at"), r["hit"].alias("hit"))))
        pieces.append("_gated")
    others = [k for k, words in enumerate(needs) if not words]
    for at in range(0, len(others), chunk):
        name = f"_hits{at}"
        df = df.withColumn(name, _found(_read(subject), [
            (parsed[k], F.struct(F.lit(k).alias("at"), _hit(parsed[k]).alias("hit"))) for k in others[at:at + chunk]]))
        pieces.append(name)
    if not pieces:
        return df.withColumn("hits", F.array().cast(HIT_TYPE))
    ordered = F.transform(F.array_sort(F.concat(*pieces)), lambda h: h["hit"])
    return df.withColumn("hits", ordered.cast(HIT_TYPE)).drop(*pieces, "_candidates")


# ── reading hits ─────────────────────────────────────────────────────────────

def has_block(hits="hits") -> Column:
    return F.exists(_c(hits), lambda h: h["severity"] == BLOCK)


def worst_severity(hits="hits") -> Column:
    return F.when(has_block(hits), BLOCK).when(F.size(_c(hits)) > 0, FLAG)


def block_reason(hits="hits") -> Column:
    first = F.try_element_at(F.filter(_c(hits), lambda h: h["severity"] == BLOCK), F.lit(1))
    return F.concat(first["id"], F.lit(": "), first["why"])


def hit_ids(hits="hits") -> Column:
    return F.transform(_c(hits), lambda h: h["id"])


def categories(hits="hits", rate_blocked: Column | None = None) -> Column:
    """Sorted distinct categories; a rate block appends 'rate' at the end."""
    cats = F.array_sort(F.array_distinct(F.transform(_c(hits), lambda h: h["category"])))
    if rate_blocked is None:
        return cats
    return F.when(rate_blocked, F.concat(cats, F.array(F.lit("rate")))).otherwise(cats)


def n_flags(hits="hits") -> Column:
    return F.size(_c(hits))


def ids_block(ids="rule_hits") -> Column:
    """Does a logged list of rule ids contain a BLOCK rule?"""
    return F.coalesce(F.arrays_overlap(_c(ids), F.array(*[F.lit(i) for i in BLOCK_IDS])),
                      F.lit(False))
