"""Translation, export, description, drafts and the streaming monitor."""

import datetime as dt

import duckdb
import pytest

from pactum.functions import checking, syntax
from pactum.operators.profiling import bin_count, spread
from pactum.plans import catalogue, export, translate
from pactum.plans.validate import validate
from pactum.sources.dictionary import load_text
from pactum.streaming.monitor import violation_windows

SF = "/root/testdata/sf0.001"
TEXT = f"""
$version: "0.1.0"
$learn_more: https://example.org
name: shop
tables:
  - name: lineitem
    source: {{parquet: {SF}/lineitem.parquet}}
    columns:
      - {{name: l_orderkey, type: number(id), examples: [1], constraints: [foreign_key]}}
      - {{name: l_quantity, type: number(quantity), range: [0, .inf], units: pieces}}
      - {{name: l_returnflag, type: enum, values: {{A: accepted, N: none, R: returned}}, constraints: [required]}}
      - {{name: l_tax, type: number(quantity), range: [0, 1], display: restricted}}
    constraints:
      - {{assert: l_quantity > 0 AND NOT l_returnflag LIKE 'X%', description: A *plain* rule.}}
      - {{assert: "COLUMNS('^l_(quantity|tax)$') >= 0"}}
    definitions:
      - {{name: bulk, expr: l_quantity > 20}}
      - {{name: total, expr: SUM(l_quantity)}}
      - {{name: twice, expr: l_quantity * 2}}
  - name: orders
    source: {{parquet: {SF}/orders.parquet}}
    columns:
      - {{name: o_orderkey, type: number(id), examples: [1], constraints: [primary_key]}}
relationships:
  - {{join: orders.o_orderkey = lineitem.l_orderkey, cardinality: one-to-many}}
glossary: {{piece: One unit.}}
"""


@pytest.fixture(scope="module")
def shop():
    d, problems = load_text(TEXT)
    assert not problems
    return d


def test_export_spec(shop):
    out = export.export_spec(shop)
    line, orders = out["tables"]
    assert [d["kind"] for d in line["definitions"]] == ["filter", "metric", "derived"]
    key = orders["columns"][0]
    assert key["constraints"] == ["primary_key", "unique", "required"]
    assert key["referenced_by"] == [{"table": "lineitem", "column": "l_orderkey"}]
    assert line["columns"][0]["references"] == {"table": "orders", "column": "o_orderkey"}
    assert line["columns"][1]["range"] == {"min": 0, "max": None}
    assert line["columns"][2]["value_labels"]["A"] == "accepted"
    (r,) = out["relationships"]
    assert r["cardinality"] == "many-to-one" and r["pairs"] == [{"left": {"table": "lineitem", "column": "l_orderkey"}, "right": {"table": "orders", "column": "o_orderkey"}}]
    assert line["constraints"][0]["description"] == "<p>A <em>plain</em> rule.</p>"
    assert line["constraints"][1]["columns"] == ["l_quantity", "l_tax"]


def test_export_data(spark, shop):
    line = export.export_data(spark, shop)["tables"][0]
    assert line["rows"] == 6000
    by = {c["name"]: c["profile"] for c in line["columns"]}
    assert set(by["l_tax"]) <= {"missing", "distinct"}
    assert "sample_values" not in by["l_returnflag"] and len(by["l_returnflag"]["common_values"]["values"]) == 3
    assert sum(b["count"] for b in by["l_quantity"]["histogram"]["bins"]) == 6000
    assert by["l_quantity"]["histogram"]["bins"][0]["closed"] == "both"
    assert by["l_orderkey"]["missing"] == 0


def test_translations(shop):
    t = shop.table("lineitem")
    out = {x["target"]: x for x in translate.translate("l_quantity BETWEEN 1 AND 5 OR STARTS_WITH(l_returnflag, '5%')", t)["translations"]}
    assert out["SQL(duckdb)"]["code"] == "\"l_quantity\" BETWEEN 1 AND 5 OR starts_with(\"l_returnflag\", '5%')"
    assert "ESCAPE" in out["SQL(ANSI)"]["code"]
    assert out["R(dplyr)"]["code"].startswith("between(l_quantity, 1L, 5L) |")
    refused = translate.translate("IS_NAN(l_quantity)", t, ["SQL"])["translations"][0]
    assert refused["fidelity"] == "unsupported" and "code" not in refused
    with pytest.raises(ValueError):
        translate.target_named("COBOL")


RULES = ["l_quantity > 20 AND NOT l_returnflag LIKE 'A%'", "MOD(l_orderkey, 7) < 3", "l_quantity / 2 > 10 OR l_tax = 0.02", "CASE WHEN l_quantity > 5 THEN l_tax > 0.01 END", "l_returnflag IN ('A', 'R')", "LENGTH(TRIM(l_returnflag)) = 1", "l_returnflag SIMILAR TO '[AN]'", "-l_quantity < -3", "ROUND(l_quantity) = l_quantity"]


@pytest.mark.parametrize("rule", RULES)
def test_emitted_sql_agrees_with_compiled(spark, rule):
    df = catalogue.table(spark, SF, "lineitem")
    scope = catalogue.scope_of(df)
    want = catalogue.violations(df, rule).count()
    duck = translate.translation(rule, scope, "SQL(duckdb)")["code"]
    assert duckdb.sql(f"SELECT count(*) FROM '{SF}/lineitem.parquet' WHERE ({duck}) IS FALSE").fetchall()[0][0] == want
    own = translate.translation(rule, scope, "Spark(sql)")["code"]
    assert df.where(f"NOT ({own})").count() == want


def test_describe_and_draft(spark, tmp_path):
    text = export.describe_text(export.describe(spark, f"{SF}/nation.parquet"))
    assert "n_name <string>" in text and "25 rows" in text
    drafted = export.draft(spark, {"orders": f"{SF}/orders.parquet"})
    d, problems = load_text(drafted)
    assert not problems
    orders = d.table("orders")
    assert orders.column("o_orderkey").type == "number(id)" and "primary_key" in orders.column("o_orderkey").constraints
    assert orders.column("o_orderstatus").values == ["F", "O", "P"]
    more = export.draft(spark, {"nation": f"{SF}/nation.parquet"}, drafted)
    assert more.startswith(drafted.rstrip("\n").rsplit("\n", 1)[0])
    both, problems = load_text(more)
    assert not problems and [t.name for t in both.tables] == ["orders", "nation"]
    assert export.draft(spark, {"orders": "x"}, more) == more


def test_small_pieces():
    assert [bin_count(n, 20) for n in (0, 1, 100, 10**6)] == [5, 5, 6, 20]
    assert spread(list(range(100)))[0] == 0 and spread(list(range(100)))[-1] == 99 and len(spread(list(range(100)))) == 20
    assert export.bar(3, 8, 1) == "▍"


def test_stream_monitor(spark, tmp_path):
    events = spark.read.parquet(f"{SF}/events.parquet")
    scope = catalogue.scope_of(events)
    rules = {"positive": "value > 50", "known": "event_type IN ('click', 'view')"}
    batch = violation_windows(events, scope, rules, "ts", "1 day")
    want = {r["rule"]: r["n"] for r in batch.groupBy("rule").agg({"violations": "sum"}).withColumnRenamed("sum(violations)", "n").collect()}
    stream = spark.readStream.schema(events.schema).parquet(f"{SF}/events.parquet*")
    q = violation_windows(stream, scope, rules, "ts", "1 day").writeStream.outputMode("complete").format("memory").queryName("monitored").option("checkpointLocation", str(tmp_path)).start()
    q.processAllAvailable()
    q.stop()
    got = {r["rule"]: r["n"] for r in spark.sql("select rule, sum(violations) n from monitored group by rule").collect()}
    assert got == want
    with pytest.raises(ValueError):
        violation_windows(events, scope, {"x": "value > AVG(value)"}, "ts")


def test_report_of_a_broken_document():
    run = validate(None, text="tables: [{name: a, columms: []}]", level="spec")
    assert run.status == "error" and {p.code for p in run.problems} == {"S60", "S64"}
    assert run.report()["problems"][0]["location"]["start_line"] == 0


def test_now_is_bound_once():
    scope = checking.Scope([checking.Declared("t", "datetime")])
    assert checking.check(syntax.parse("t < NOW()"), scope).ok
    assert dt.datetime(2024, 1, 1) < dt.datetime.now()


def test_profile_of_many_distinct_values_is_bounded(spark):
    """Beyond the exact limit: a heavy value is found, the distinct count is about right, samples are drawn from all values."""
    from pactum.operators.profiling import SAMPLES, profile

    df = spark.range(20_000).selectExpr(
        "CASE WHEN id % 2 = 0 THEN 'heavy' ELSE concat('v', id) END AS s", "id % 900 AS few", "id * 1.5D AS x", "id AS whole", "CASE WHEN id % 3 = 0 THEN NULL ELSE id % 2 = 0 END AS flag",
    )
    columns = {c: df[c] for c in df.columns}
    sc = spark.sparkContext
    sc.setJobGroup("profile", "five columns")
    p = profile(df, columns)
    few_jobs = len(sc.statusTracker().getJobIdsForGroup("profile"))
    sc.setJobGroup("profile-twice", "ten columns")
    profile(df, columns | {c + "2": df[c] for c in df.columns})
    assert len(sc.statusTracker().getJobIdsForGroup("profile-twice")) == few_jobs  # jobs don't grow with columns
    sc.setLocalProperty("spark.jobGroup.id", None)
    assert p["s"].approximate and p["s"].top[0][0] == "heavy" and abs(p["s"].top[0][1] - 10_000) < 100 and abs(p["s"].distinct - 10_001) < 300
    assert not p["few"].approximate and p["few"].distinct == 900 and p["few"].top[0] == (0, 23, 0) and len(p["few"].top) == 20
    assert sorted(p["flag"].top) == [(False, 6667, 0), (True, 6666, 0)] and p["flag"].nulls == 6667
    assert len(p["s"].samples) == len(p["x"].samples) == SAMPLES and p["x"].samples == sorted(p["x"].samples) and set(p["whole"].samples) <= set(range(20_000))


def test_bytes_that_are_no_text_are_not_summarised(spark):
    from pactum.operators.profiling import profile

    df = spark.createDataFrame([(b"otter", b"\xff\xfe"), (b"seal", b"ok"), (None, None)], "good binary, bad binary")
    df = df.withColumn("worse", df["bad"].cast("string"))
    p = profile(df, {c: df[c] for c in df.columns})
    assert p["good"].supported and (p["good"].low, p["good"].distinct, p["good"].nulls) == ("otter", 2, 1)
    assert [(p[c].kind, p[c].supported, p[c].nulls, p[c].top, p[c].low) for c in ("bad", "worse")] == [("binary", False, 1, [], None)] * 2


PAGE = """
$version: "0.1.0"
$learn_more: https://example.org
tables:
  - name: t
    description: Otters & <friends>
    source: {parquet: t.parquet}
    columns:
      - {name: id, type: number(id), examples: [1], constraints: [primary_key], description: The "key"}
      - {name: kind, type: enum, values: [a, b]}
      - {name: secret, type: string, examples: [x], display: restricted}
      - {name: x, type: number, examples: [1.5], todo: units}
    constraints: [{assert: x < 3}]
relationships: []
glossary: {otter: A swimmer.}
"""


def test_the_page_holds_tables_columns_profiles_and_no_restricted_value(spark, tmp_path):
    from html.parser import HTMLParser

    import pyarrow as pa
    import pyarrow.parquet as pq

    from pactum.plans.page import render
    from pactum.sources.dictionary import load_text

    d, _ = load_text(PAGE, str(tmp_path / "d.yaml"))
    plain = render(None, d)  # no data: no session is asked for
    assert "Otters &amp; &lt;friends&gt;" in plain and 'class="bars"' not in plain
    pq.write_table(pa.table({"id": range(60), "kind": ["a", "b"] * 30, "secret": [f"undisclosed{k}" for k in range(60)], "x": [k / 2 for k in range(60)]}), tmp_path / "t.parquet")
    text = render(lambda: spark, d)
    assert "60 rows" in text and 'class="bars"' in text and "60 distinct" in text and "undisclosed" not in text and "A swimmer." in text and "x &lt; 3" in text

    class Balance(HTMLParser):
        def __init__(self):
            super().__init__()
            self.open, self.ids = [], []

        def handle_starttag(self, tag, attributes):
            self.ids += [v for k, v in attributes if k == "id"]
            if tag not in ("meta", "input", "br"):
                self.open.append(tag)

        def handle_endtag(self, tag):
            assert self.open.pop() == tag

    for page in (plain, text):
        seen = Balance()
        seen.feed(page)
        assert not seen.open and {"t", "t.id", "t.kind", "t.secret", "t.x"} <= set(seen.ids)


def test_the_verb_render_writes_a_file(spark, tmp_path, capsys):
    from pactum.__main__ import main

    (tmp_path / "d.yaml").write_text(PAGE)
    assert main(["render", str(tmp_path / "d.yaml"), "--output", str(tmp_path / "d.html")]) == 0
    assert (tmp_path / "d.html").read_text().startswith("<!doctype html>") and capsys.readouterr().out == ""


@pytest.mark.parametrize("verb", ["spec", "skill-read", "skill-create"])
def test_the_verbs_that_print_a_guide(verb, capsys):
    from pactum.__main__ import main
    from pactum.functions.checking import AGGREGATES, SCALAR_FUNCTIONS
    from pactum.plans.validate import KINDS

    assert main([verb]) == 0
    text = capsys.readouterr().out
    assert text.startswith("# ") and len(text.splitlines()) > 5
    if verb == "spec":
        assert all(f"`{x}`" in text for x in [*SCALAR_FUNCTIONS, *AGGREGATES, *(k for k in KINDS if " " not in k)]) and "{" not in text.replace("{parquet: path}", "")
