"""The search engine on small worked examples."""

import random

import duckdb
import pytest

from quillspark.errors import SearchError
from quillspark.functions.analysis import analyze, edits, fuzzy_eligible, surface
from quillspark.functions.porter2 import stem
from quillspark.operators.aggregate import bounds
from quillspark.operators.search import Searcher
from quillspark.operators.trace import WORK, Sources, evaluate, snippets, sources, trace_matches, trace_page, trace_values
from quillspark.plans.request import normalize, request
from quillspark.sources.index import TextIndex, TextReader, as_records, build, inspect_index, reclaim_retired, rejections, reset_index, validate_options

OPTIONS = validate_options(["title"], [{"name": "colour", "type": "string"}, {"name": "height", "type": "number"}], surface_terms=True)
LAMPS = [("oak", [40.0], ["green"]), ("elm", [15.0, 90.0], ["red", "green", "red"]), ("fir", [62.5], ["blue"]), ("ash", [], ["amber"]), ("yew", [7.0], []), ("box", [15.0], ["red"])]


def lamps(spark):
    rows = [(i, "7", ["reading lamp" + (" with dimmer" if i == "elm" else "")], c, h) for i, h, c in LAMPS]
    return spark.createDataFrame(rows, "id string, version string, t_title array<string>, f_colour array<string>, f_height array<double>")


@pytest.fixture(scope="module")
def searcher(spark):
    return Searcher(build(lamps(spark), OPTIONS))


def test_stems():
    # Pairs from the published description of the English (Porter 2) stemmer.
    pairs = "consign consign consigned consign consigning consign consignment consign consist consist consisted consist consistency consist consistently consist consolation consol knack knack knackeries knackeri knaves knave knavish knavish kneaded knead knightly knight knocking knock knots knot skies sky dying die generously generous"
    words = pairs.split()
    assert [(w, stem(w)) for w in words[::2]] == list(zip(words[::2], words[1::2], strict=True))


def test_analysis():
    assert [(t.term, t.position) for t in analyze("Salt and pepper")] == [("salt", 0), ("pepper", 2)]
    assert [t.term for t in surface("The gardener’s ﬁne Ｇａrden, Öland, Groß")] == ["the", "gardener", "fine", "garden", "oland", "gross"]
    assert surface("x" * 39) and not surface("x" * 40)
    assert edits("lantern", "lantren") == 1 and edits("lantern", "lantren", False) == 2 and edits("lant", "lamterns", prefix=True) == 1
    assert [fuzzy_eligible(w) for w in ("abc", "abcd", "abc4", "1234", "ab-cd")] == [False, True, False, False, False]


def test_validation():
    with pytest.raises(SearchError):
        bounds([{"from": 1, "to": 2}, {"from": 3}])
    with pytest.raises(SearchError):
        validate_options([])
    assert bounds([{"from": 1, "to": 2}]) == [(None, 1), (1, 2), (2, None)]
    for bad in ({}, {"text": "a", "query": {"text": "b"}}, {"text": "a", "mode": "near"}, {"text": "a", "fuzzyDistance": 1}, {"text": "a", "mode": "fuzzy", "fuzzyDistance": 3}, {"text": "a", "fields": ["body"]}, {"text": "a", "limit": 0}, {"text": "a", "offset": 9_990}, {"query": {"operator": "and", "clauses": []}}, {"query": {"operator": "boost", "boost": 101, "clause": {"text": "a"}}}, {"text": "a", "candidateIds": [""]}, {"text": "x" * 65_537}):
        with pytest.raises(SearchError):
            request(bad, ["title"])
    deep = {"text": "a"}
    for _ in range(9):
        deep = {"operator": "not", "clause": deep}
    with pytest.raises(SearchError):
        normalize(deep, ["title"])


def test_search_and_sort(searcher):
    ids = lambda **k: [h["id"] for h in searcher.search({"text": "reading lamps", "mode": "all", **k})["hits"]]
    assert ids(sort={"field": "height", "direction": "desc", "missing": "last"}) == ["fir", "oak", "box", "elm", "yew", "ash"]
    assert ids(sort={"field": "height", "direction": "asc", "missing": "first"}) == ["ash", "yew", "box", "elm", "oak", "fir"]
    assert ids(sort=[{"field": "colour", "direction": "asc", "missing": "first"}, {"field": "height", "direction": "desc", "missing": "first"}]) == ["yew", "ash", "fir", "oak", "box", "elm"]
    assert ids(filter={"field": "height", "comparator": "missing"}) == ["ash"]
    assert [h["id"] for h in searcher.search({"text": "lamp dimmer", "mode": "phrase"})["hits"]] == []
    assert [h["id"] for h in searcher.search({"text": "lamp with dimmer", "mode": "phrase"})["hits"]] == ["elm"]
    assert [h["id"] for h in searcher.search({"text": "dinmer", "mode": "fuzzy"})["hits"]] == ["elm"]
    assert [h["id"] for h in searcher.search({"text": "lamp dim", "mode": "prefix"})["hits"]] == ["elm"]
    assert [(r["rank"], r["id"], r["version"]) for r in searcher.ranked({"text": "lamp", "offset": 1, "limit": 3}).collect()] == [(1, "box", "7"), (2, "fir", "7"), (3, "oak", "7")]
    with pytest.raises(SearchError):
        ids(sort={"field": "title", "direction": "asc", "missing": "first"})


def test_facets(searcher):
    ask = [{"name": "heights", "type": "stats", "field": "height"}, {"name": "colours", "type": "terms", "field": "colour", "size": 2, "aggregations": [{"name": "steps", "type": "histogram", "field": "height", "interval": 50}, {"name": "ends", "type": "range", "field": "height", "ranges": [{"from": 10, "to": 50}]}]}]
    out = searcher.search({"text": "lamp", "aggregations": ask})
    stats, colours = out["aggregations"]
    assert out["total"] == 6 and (stats["count"], stats["sum"], stats["min"], stats["max"]) == (6, 229.5, 7, 90)
    assert [(b["key"], b["count"]) for b in colours["buckets"]] == [("green", 2), ("red", 2)] and colours["sumOtherDocCount"] == 2
    green = colours["buckets"][0]["aggregations"]
    assert [(b["key"], b["count"]) for b in green[0]["buckets"]] == [(0, 2), (50, 1)]
    assert [(b["key"], b["count"]) for b in green[1]["buckets"]] == [("*-10", 0), ("10-50", 2), ("50-*", 1)]
    none = searcher.search({"text": "nothing", "aggregations": ask})["aggregations"]
    assert none[0]["count"] == 0 and none[0]["min"] is None and none[1]["buckets"] == []
    with pytest.raises(SearchError):
        searcher.search({"text": "lamp", "aggregations": [{"name": "x", "type": "histogram", "field": "height", "interval": 1e-3, "aggregations": ask[1:]}, {"name": "x", "type": "stats", "field": "height"}]})


def test_budgets(searcher):
    wide = Searcher(searcher.t)
    for bad in ({"text": " ".join(f"word{chr(97 + k // 26)}{chr(97 + k % 26)}" for k in range(90)), "mode": "any"}, {"query": {"operator": "or", "clauses": [{"text": f"lamp {'abcdefghij'[k]}cdefg", "mode": "fuzzy", "fuzzyDistance": 2} for k in range(10) for _ in range(7)]}}, {"text": "la", "mode": "prefix"}):
        with pytest.raises(SearchError):
            wide.matches(bad).collect()


def test_pages(searcher):
    seen, req = [], {"text": "lamp", "limit": 2}
    while True:
        page = searcher.search_page(req)
        assert page["total"] == 6
        seen += [h["id"] for h in page["hits"]]
        if "continuation" not in page:
            break
        req = req | {"continuation": page["continuation"]}
    assert seen == ["ash", "box", "fir", "oak", "yew", "elm"]
    with pytest.raises(SearchError, match="E_INVALID_ARGUMENT"):
        searcher.search_page(req | {"text": "reading"})


def test_trace_spans():
    opts = {"snippets": True, "fragmentLength": 32, "maxFragmentsPerValue": 2}
    record = {"id": "x", "fields": {"title": "🪔🪔 an Oil Lamp burning by an oil lamp"}}
    got = trace_matches({"text": "oil lamps", "mode": "phrase"}, [record], OPTIONS, opts)["records"][0]["values"][0]
    assert got["spans"] == [{"start": 8, "end": 16}, {"start": 31, "end": 39}]
    text = record["fields"]["title"].encode("utf-16-le")
    for f in got["fragments"]:
        assert text[2 * f["start"] :].startswith(f["text"].encode("utf-16-le"))
        assert all(f["text"].encode("utf-16-le")[2 * s["start"] : 2 * s["end"]].decode("utf-16-le").lower() == "oil lamp" for s in f["spans"] if s["end"] - s["start"] == 8)
    assert snippets("a" * 100, [(0, 4), (2, 5), (90, 100)], 32, 3) == [{"text": "a" * 32, "start": 0, "spans": [{"start": 0, "end": 4}, {"start": 2, "end": 5}]}, {"text": "a" * 32, "start": 68, "spans": [{"start": 22, "end": 32}]}]


def test_trace_modes_agree_with_search(spark):
    words = "amber anbers basil basils cedar cedars dill adder".split()
    rng = random.Random(3)
    texts = {f"r{k}": " ".join(rng.choices(words, k=rng.randint(1, 5))) for k in range(40)}
    df = as_records(spark.createDataFrame(list(texts.items()), "id string, title string").selectExpr("id", "title", "null as colour", "null as height"), OPTIONS)
    s = Searcher(build(df, OPTIONS))
    leaf = [{"text": "amber basil", "mode": m} for m in ("any", "all", "phrase", "fuzzy")] + [{"text": "cedar bas", "mode": "prefix"}, {"text": "cedar basl", "mode": "fuzzy-prefix"}]
    asks = [*leaf, {"operator": "not", "clause": leaf[3]}, {"operator": "and", "clauses": [leaf[0], {"operator": "not", "clause": leaf[4]}]}, {"operator": "or", "clauses": [leaf[2], leaf[5]]}, {"operator": "optional", "required": leaf[0], "optional": [leaf[4]]}, {"operator": "boost", "boost": 0, "clause": leaf[1]}]
    for a in asks:
        found = {r["id"] for r in s.matches({"query": a}).collect()}
        tree = normalize(a, ["title"])
        assert found == {i for i, t in texts.items() if trace_values(tree, {"title": [t]}, OPTIONS)[0]}, a


def test_trace_in_three_values(monkeypatch):
    from quillspark.operators import trace

    monkeypatch.setattr(trace, "VALUE_TOKENS", 3)
    values = {"title": ["one two three four"]}
    ask = lambda q: evaluate(normalize(q, ["title"]), sources(values, OPTIONS, WORK), OPTIONS)[0]
    known, hidden = {"text": "two"}, {"text": "four"}
    no = lambda q: {"operator": "not", "clause": q}
    assert ask(known) is True and ask(hidden) is None and ask(no(hidden)) is None and ask(no(known)) is False
    assert ask({"operator": "or", "clauses": [hidden, known]}) is True and ask({"operator": "and", "clauses": [hidden, no(known)]}) is False
    assert ask({"operator": "and", "clauses": [hidden, known]}) is None
    page = trace_page({"text": "four"}, [{"id": "a", "fields": values}], OPTIONS)
    assert page["states"] == [{"membership": None, "analysisComplete": False, "spansComplete": False}] and not page["complete"] and page["nextRecord"] == 1
    many = [{"id": str(k), "fields": {"title": ["two " * 2]}} for k in range(3)]
    monkeypatch.setattr(trace, "SPANS", 3)
    page = trace_page({"text": "two"}, many, OPTIONS)
    assert page["nextRecord"] == 1 and [r["id"] for r in page["records"]] == ["0"]
    monkeypatch.setattr(trace, "WORK", 5)
    monkeypatch.setattr(trace, "SPANS", 100)
    assert trace_page({"text": "two"}, many, OPTIONS)["nextRecord"] == 2
    assert evaluate(normalize(known, ["title"]), Sources([], {"title"}), OPTIONS)[0] is None


def test_stored_index(spark, tmp_path):
    """Commits of changed documents alone, merged now and then, are as an index built from what lives."""
    path, rng, alive = f"{tmp_path}/index", random.Random(11), {}
    index = TextIndex.open(spark, path, OPTIONS)
    reader = TextReader.open(spark, path, OPTIONS)
    words = "ash birch cedar douglas elm fir".split()
    for n in range(5):
        new = {str(k): " ".join(rng.choices(words, k=4)) for k in rng.sample(range(30), 9)}
        gone = [k for k in map(str, rng.sample(range(30), 3)) if k not in new]
        ups = as_records(spark.createDataFrame([(k, t, "red", float(len(t))) for k, t in new.items()], "id string, title string, colour string, height double"), OPTIONS)
        assert index.apply(ups, spark.createDataFrame([(g,) for g in gone], "id string")).count() == 0
        index.publish(str(n))
        alive = {k: t for k, t in (alive | new).items() if k not in gone}
        assert index.tables.n_docs == len(alive) and sorted(r[0] for r in index.tables.docs.select("id").collect()) == sorted(alive)
    fresh = build(as_records(spark.createDataFrame([(k, t, "red", float(len(t))) for k, t in alive.items()], "id string, title string, colour string, height double"), OPTIONS), OPTIONS)
    for t in ("postings", "terms"):
        cols = ["surface", "field", "term", *(["id", "tf", "positions", "len"] if t == "postings" else ["df", "total"])]
        both = [sorted((tuple(r) for r in getattr(x, t).select(cols).collect()), key=repr) for x in (index.tables, fresh)]
        assert both[0] == both[1]
    assert index.tables.totals == fresh.totals
    assert reader.tables.n_docs == 0
    reader.reload()
    assert reader.committed_payload == "4" and reader.tables.n_docs == len(alive)
    assert len(index.manifest["segments"]) < 5
    with pytest.raises(SearchError, match="E_CHECKPOINT_REQUIRED"):
        index.commit()
    index.apply(None, spark.createDataFrame([("1",)], "id string"))
    with pytest.raises(SearchError, match="E_DIRTY_CLOSE"):
        index.close()
    index.close("rollback")
    assert inspect_index(spark, path, OPTIONS) == {"state": "checkpointed", "payload": "4"}
    assert inspect_index(spark, path, validate_options(["other"])) == {"state": "incompatible"}
    with pytest.raises(SearchError, match="E_IDENTITY_MISMATCH"):
        TextReader.open(spark, path, validate_options(["other"]))
    assert reset_index(spark, path).startswith(path) and inspect_index(spark, path, OPTIONS) == {"state": "missing"}
    assert reclaim_retired(spark, path) and not reclaim_retired(spark, path)
    with pytest.raises(SearchError, match="E_INDEX_NOT_READY"):
        TextReader.open(spark, path, OPTIONS)
    (tmp_path / "index").mkdir()
    (tmp_path / "index" / "mine").write_text("x")
    with pytest.raises(SearchError, match="E_INDEX_CORRUPT"):
        reset_index(spark, path)


def test_rejections(spark):
    df = spark.createDataFrame([("a", "x", "red", 1.0), (None, "x", "red", 1.0), ("", "x", "red", 1.0), ("b", "x", "y" * 70_000, 1.0), ("c", "x", "red", float("inf"))], "id string, title string, colour string, height double")
    assert sorted(map(tuple, rejections(as_records(df, OPTIONS), OPTIONS).collect()), key=repr) == sorted([(None, "upsert", "E_INVALID_ARGUMENT"), ("", "upsert", "E_INVALID_ARGUMENT"), ("b", "upsert", "E_RESOURCE_LIMIT"), ("c", "upsert", "E_INVALID_ARGUMENT")], key=repr)


def test_streaming_ingest(spark, tmp_path):
    from quillspark.streaming.ingest import ingest

    kind = "id string, title string, colour string, height double, op string, seq int"
    batch = [("a", "pine", "red", 1.0, "upsert", 0), ("a", "larch", "red", 1.0, "upsert", 1), ("b", "pine", "red", 2.0, "upsert", 0)]
    spark.createDataFrame(batch, kind).coalesce(1).write.parquet(f"{tmp_path}/in")
    index = TextIndex.open(spark, f"{tmp_path}/index", OPTIONS)
    run = lambda: ingest(index, spark.readStream.schema(kind).parquet(f"{tmp_path}/in"), f"{tmp_path}/log").awaitTermination(120)
    assert run()
    spark.createDataFrame([("b", "", "", 0.0, "delete", 0)], kind).coalesce(1).write.mode("append").parquet(f"{tmp_path}/in")
    assert run()
    assert [r["id"] for r in Searcher(index.tables).matches({"text": "larch pine"}).collect()] == ["a"]


@pytest.mark.parametrize("name", ["t1_top_k", "t5_sort", "g5_nested", "m3_phrase", "m6_fuzzy_prefix", "s2_reader"])
def test_query_against_sql(spark, name):
    from quillspark.queries import ORACLES, QUERIES

    at = "/root/testdata/sf0.001"
    con = duckdb.connect()
    for t in ("documents", "labels", "part", "lineitem"):
        con.sql(f"CREATE VIEW {t} AS SELECT * FROM '{at}/{t}.parquet'")
    got = QUERIES[name](spark, at)
    cols = sorted(got.columns)
    want = con.sql(f"SELECT {', '.join(cols)} FROM ({ORACLES[name]})").fetchall()
    assert sorted(map(repr, map(tuple, got.select(cols).collect()))) == sorted(map(repr, want))


def test_publish_changes_every_row(spark, tmp_path):
    from quillspark.queries import QUERIES, _changes

    docs = spark.createDataFrame([(k, f"text of {k}", "en", "s", 9) for k in range(24)], "id long, text string, lang string, source string, n_chars long")
    got = {r["id"]: (r["op"], r["text"].endswith(" newcomer")) for r in _changes(docs).collect()}
    assert got == {k: ("upsert" if k % 3 else "delete", k % 2 == 0) for k in range(24)}
    docs.withColumnRenamed("id", "doc_id").write.parquet(f"{tmp_path}/documents.parquet")
    assert sorted(int(r[0]) for r in QUERIES["s7_publish"](spark, str(tmp_path)).collect()) == [k for k in range(24) if k % 2 == 0 and k % 3]


def test_queries_match_all_words_of_a_stem(spark, tmp_path):
    """The SQL names the forms that small tables have; larger ones have others, and the queries find those as well."""
    from quillspark.queries import QUERIES

    texts = ["thndly", "thndlying days", "ofonrereing", "thndl", "ofonrereer thndlyed", None]
    spark.createDataFrame([(k, t, "en", "src1", len(t or "")) for k, t in enumerate(texts)], "doc_id long, text string, lang string, source string, n_chars int").write.parquet(f"{tmp_path}/documents.parquet")
    ids = lambda name: {r["id"] for r in QUERIES[name](spark, str(tmp_path)).collect()}
    assert ids("m1_any") == ids("b2_or") == ids("h1_trace") == {"0", "1", "2", "4"}
    assert ids("b3_not") == {"3", "5"}
    assert ids("b1_and") == {"4"}
    assert ids("b5_optional") == {"2", "4"}


@pytest.mark.parametrize("stop_words", [True, False])
def test_index_takes_the_words_of_the_analysis(stop_words):
    """The index gathers positions without tokens; they are those of the one analysis."""
    from quillspark.functions.analysis import both, gather

    rules = {"lamp": ("light", "torch")}
    for text in ("Salt and the lamps", "the gardener’s ﬁne Ｇａrden", "dog's S 's x's s Groß lamp", "a" * 50 + " b" + "é" * 30, "", "don'ś é's", "x" * 39 + " " + "x" * 40):
        shown, stems, last = both(text, stop_words, rules)
        got: tuple[dict, dict] = ({"lamp": [1]}, {})
        assert gather(text, stop_words, rules, 7, *got) == (len(stems), len(shown), last)
        for have, tokens in zip(got, (stems, shown), strict=True):
            want = {"lamp": [1]} if have is got[0] else {}
            for t in tokens:
                want.setdefault(t.term, []).append(7 + t.position)
            assert have == want


def test_a_batch_that_replaces_all_rewrites_nothing(spark, tmp_path):
    """Segments without a living document are left behind: no merge writes the new one again, and the dictionary has no trace of them."""
    options = validate_options(["text"], surface_terms=True)
    index = TextIndex.open(spark, str(tmp_path / "index"), options)
    for batch, word in enumerate(("oak", "elm")):
        rows = [(str(i), f"{word} tree {i}") for i in range(5 - batch)]
        gone = spark.createDataFrame([("4",)], "id string") if batch else None
        index.apply(as_records(spark.createDataFrame(rows, "id string, text string"), options), gone)
        index.publish(str(batch))
    assert [s["seg"] for s in index.manifest["segments"]] == ["2"] and index.manifest["dead"] == []
    assert index.tables.n_docs == 4 and {(r["term"], r["df"]) for r in index.tables.terms.where("not surface").collect()} == {("elm", 4), ("tree", 4), *((str(i), 1) for i in range(4))}
    assert {r["id"] for r in Searcher(index.tables).matches({"text": "elm oak"}).collect()} == {"0", "1", "2", "3"}


def test_postings_are_those_of_the_analysis(monkeypatch):
    import pyarrow as pa
    from quillspark.functions.analysis import both
    from quillspark.sources import index as module

    monkeypatch.setattr(module, "_AT_ONCE", 5)
    rules = [{"source": "lamp", "replacements": ["torch", "oil"]}, {"source": "torch", "replacements": ["fire"]}]
    options = validate_options(["title", "text"], surface_terms=True, synonyms=rules)
    texts = [["dog's S 's x's lamp's torch", "lamp oil"], [], ["the lamps of the gardener’s ﬁne Ｇａrden"], ["", "a b lamp"], ["a" * 50 + " b" + "é" * 30]]
    title = [["Lamp lamp"], ["'s"], [], ["don'ś é's"], [""]]
    batch = pa.RecordBatch.from_arrays([pa.array(list("vwxyz")), *(pa.array(c, pa.list_(pa.string())) for c in (title, texts))], names=["id", "t_title", "t_text"])
    got = [tuple(r.values()) for b in module._postings(options, iter([batch.slice(0, 2), batch.slice(2)])) for r in b.to_pylist()]
    want = {}
    for k, col in enumerate((title, texts)):
        for i, values in zip("vwxyz", col, strict=True):
            base, found = 0, ([], [])
            for v in values:
                shown, stems, last = both(v, True, dict(options.synonyms))
                for to, tokens in zip(found, (stems, shown), strict=True):
                    to += [(t.term, base + t.position) for t in tokens]
                base += last + 2
            for raw in (False, True):
                for term in {t for t, _ in found[raw]}:
                    at = [p for t, p in found[raw] if t == term]
                    want[raw, k, term, i] = (len(at), None if raw else at, len(found[raw]))
    assert len(got) == len(want) and {r[:4]: r[4:] for r in got} == want
