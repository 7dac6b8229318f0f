"""One trigger per signature, and everyday traffic that must pass."""
import pytest
from pyspark.sql import functions as F

from reqlens.functions import literals, rules, text

# rule id -> (path, query, body) that triggers it
TRIGGERS = {
    "sqli.union": ("/s", "q=0 UnIoN/**/aLL SELECT pw", ""),
    "sqli.tautology": ("/s", "id=7%27%20or%20%27a%27%3D%27a%27%20--", ""),
    "sqli.stacked_ddl": ("/s", "", "x; truncate   table t"),
    "sqli.stacked_dml": ("/s", "", "x; delete from t"),
    "sqli.xp_cmdshell": ("/s", "", "call sp_executesql now"),
    "sqli.timing": ("/s", "id=1 or pg_sleep (9)", ""),
    "sqli.schema": ("/s", "t=pg_catalog", ""),
    "sqli.comment_terminator": ("/s", "u=bob'--", ""),
    "xss.script_tag": ("/c", "t=%253Cscript%253E", ""),
    "xss.event_handler": ("/c", "", "<img src=1 onload =x()>"),
    "xss.js_uri": ("/r", "to=JavaScript:alert(2)", ""),
    "xss.dom_exfil": ("/c", "", "document . location"),
    "xss.svg_iframe": ("/c", "", "&lt;iframe onmessage=x"),
    "traversal.dotdot": ("/f/%2e%2e/x", "", ""),
    "traversal.semicolon": ("/f/..;/x", "", ""),
    "traversal.unix_secrets": ("/x", "", "cat /proc/self/cmdline"),
    "traversal.win_secrets": ("/x", "", "c:\\boot.ini"),
    "cmdi.chained": ("/p", "h=1|whoami", ""),
    "cmdi.substitution": ("/p", "", "$( uname )"),
    "cmdi.reverse_shell": ("/p", "", "mkfifo"),
    "ssti.expr": ("/t", "", "hi {{ 7*7 }}"),
    "scan.vcs_secrets": ("/.svn/entries", "", ""),
    "scan.admin_panels": ("/phpmyadmin/x", "", ""),
    "scan.config_files": ("/web.config", "", ""),
    "deser.java": ("/i", "", "x = ObjectInputStream"),
    "ssrf.metadata": ("/g", "u=http://metadata.google.internal/", ""),
}
HARMLESS = [
    ("/api/search", "q=administrator", ""), ("/api/search", "q=50%", ""),
    ("/api/search", "q=credit+union+members", ""), ("/api/people", "", '{"name":"D\'Arcy"}'),
    ("/api/notes", "", "pass -- to stop parsing options"), ("/api/x", "", "select one or two"),
    ("/api/files/a.b.2024.tar", "", ""), ("/v3/items/77", "min=1&max=9", ""),
    ("/api/people", "mail=jo%40example.org", ""), ("/health", "", ""),
    ("/api/i18n", "", "na\\u00efve caf\\u00e9"), ("/api/text", "", "lorem ipsum " * 300),
]


def scan(spark, cases):
    df = spark.createDataFrame([(i, *c) for i, c in enumerate(cases)],
                               "i int, path string, query string, body string")
    return text.with_payload(df).withColumn("hits", rules.scan())


def test_every_rule_triggers(spark):
    ids = list(TRIGGERS)
    got = scan(spark, TRIGGERS.values()).select("i", rules.hit_ids().alias("ids")).collect()
    for r in got:
        assert ids[r.i] in r.ids, ids[r.i]
    assert set(ids) == {r.id for r in rules.CATALOGUE}


def test_harmless_traffic_is_not_blocked(spark):
    got = scan(spark, HARMLESS).filter(rules.has_block()).select("path", "query", "body").collect()
    assert got == []


def test_severity_reason_categories(spark):
    df = scan(spark, [("/wp-admin", "", ""), ("/x", "q=1 union select a", "<script> {{a}}"), ("/", "", "")])
    got = df.orderBy("i").select(
        rules.worst_severity().alias("w"), rules.block_reason().alias("r"),
        rules.categories().alias("c"), rules.categories("hits", F.lit(True)).alias("cr"),
        rules.n_flags().alias("n")).collect()
    assert [r.w for r in got] == ["flag", "block", None]
    assert got[0].r is None and got[1].r.startswith("sqli.union: UNION")
    assert got[1].c == ["sqli", "ssti", "xss"] and got[1].cr == ["sqli", "ssti", "xss", "rate"]
    assert [r.n for r in got] == [1, 3, 0]


def test_targets_and_empty_subjects(spark):
    df = spark.createDataFrame([("", "/../"), ("/../", ""), (None, None)], "canon_path string, canon_body string")
    got = df.select(rules.hit_ids(rules.scan()).alias("ids")).collect()
    assert [r.ids for r in got] == [[], ["traversal.dotdot"], []]


@pytest.mark.parametrize("body,hit", [("", True), ("x", False)])
def test_end_anchor_is_the_end_of_the_subject(spark, body, hit):
    df = spark.createDataFrame([("/s?i=1' or a=a", body)], "canon_path string, canon_body string")
    ids = df.select(rules.hit_ids(rules.scan())).first()[0]
    assert ("sqli.tautology" in ids) is hit


def test_unicode_case_folding(spark):
    df = spark.createDataFrame([("/", "union\u00a0\u017felect")], "canon_path string, canon_body string")
    assert df.select(rules.hit_ids(rules.scan())).first()[0] == ["sqli.union"]


def test_user_rules_in_chunks(spark):
    mine = rules.rules_table(spark)
    cases = scan(spark, TRIGGERS.values()).withColumn("want", rules.hit_ids())
    got = rules.scan_table(cases.drop("hits"), mine, chunk=7)
    assert got.filter(rules.hit_ids() != F.col("want")).count() == 0


def test_catalogue_is_sound():
    ids = [r.id for r in rules.CATALOGUE]
    assert len(ids) == len(set(ids)) == 26 and len(rules.BLOCK_IDS) == 22
    assert all(len(r.why) > 10 and r.severity in (rules.BLOCK, rules.FLAG) for r in rules.CATALOGUE)


def test_user_rules_beyond_the_bound_are_refused(spark):
    df = scan(spark, HARMLESS).drop("hits")
    with pytest.raises(ValueError, match="max_bytes"):
        rules.scan_table(df, rules.rules_table(spark), max_bytes=100)
    none = rules.scan_table(df, rules.rules_table(spark).limit(0))
    assert none.filter(F.size("hits") > 0).count() == 0


@pytest.mark.parametrize("pattern,want", [
    (r"union\s+(?:all\s+)?select", {"select"}), (r"(?:foo|barbar)+x", {"foo", "barbar"}), (r"abc*", {"ab"}),
    (r"(?:abc)?", set()), (r"(?:abc|)", set()), (r"abc|\d", set()), (r"[abc]def", {"def"}), (r"\bKEY\s*=", {"key"}),
    (r"(?!never)then", {"then"}), (r"[a[bc]]tail", set()), (r"\Qa.b\E", set()), (r"(?x) a b c d", set()),
    (r"\p{L}word", set()), (r"a{0,2}", set()), ("été", set()), ("(", set()), ("", set())])
def test_required_literals(pattern, want):
    assert set(literals.required(pattern)) == want


def test_rules_with_literals_are_tried_wherever_they_match(spark):
    """Each pattern on texts that hold matches of it in several cases, beside scan();
    rules share ids."""
    patterns = [r"union\s+select", r"ki\w", "(?:tick|toc)k", "sis$", r"\d+", "(?i)ABC.DEF", "a+b", "x{2}yz"]
    own = [rules.Rule(f"r{i % 4}", "c", rules.FLAG, (rules.ANY, rules.PATH, rules.BODY)[i % 3], p, "w")
           for i, p in enumerate(patterns * 3)]
    words = ["UNION select", "unıon ſelect", "Kİx", "ticKk", "TOCK", "sis", "SIſ", "12",
             "abcédef", "aab", "xxyz", "XxYZ", "", None, "plain"]
    df = spark.createDataFrame([(a, b) for a in words for b in words], "canon_path string, canon_body string")
    table = spark.createDataFrame([(i, *vars(r).values()) for i, r in enumerate(own)], ["ordinal", *vars(own[0])])
    got = rules.scan_table(df.withColumn("want", rules.scan(rules=own)), table, chunk=5).collect()
    assert all(r["hits"] == r["want"] for r in got) and sum(len(r["want"]) for r in got) > 300
    assert {h["id"] for r in got for h in r["want"]} == {"r0", "r1", "r2", "r3"}


def test_rules_are_tried_only_where_their_literals_stand(spark):
    from reqlens.functions import literals
    assert literals.all_required(r"<\s*script[\s/>]") == [("script",), ("<",)]
    assert literals.all_required(r"[;|]\s*(?:cat|ls)(?:x)?") == [("cat", "ls"), (";", "|")]
    assert literals.all_required(r"\w+[^;]x?") == []
    texts = ["<SCRIPT>", "<ſcript>", "unıon ſelect", "UNİON SELECT", "x' or 1=1 --", "; lS", "a $(id) `b`",
             "booK", "<svg é onload=", "/etc/passwd", "{{7*7}}", "plain", "ab " * 30_000 + "<script>"]
    rows = [(i, "/" + (t if i % 2 else ""), t) for i, t in enumerate(texts)]
    df = spark.createDataFrame(rows, "i int, canon_path string, canon_body string")
    subject = {rules.PATH: F.col("canon_path"), rules.BODY: F.col("canon_body"),
               rules.ANY: F.concat("canon_path", F.lit("\n"), "canon_body")}
    every = F.array_compact(F.array(*[F.when(subject[r.target].rlike(rules.REGEX_FLAGS + r.pattern), r.id)
                                      for r in rules.CATALOGUE]))
    got = df.select(rules.hit_ids(rules.scan()).alias("got"), every.alias("want")).collect()
    assert [r.got for r in got] == [r.want for r in got]
    assert sum(map(len, (r.got for r in got))) > 8
