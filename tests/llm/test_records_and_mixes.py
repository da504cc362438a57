"""WARC round trips and salvage, tool calls, mixing, decontamination and the pipeline."""

import base64
import gzip
import time
import hashlib
import json
import random
import zlib

import duckdb
import pyarrow as pa
import pytest

import corpus_pipeline
from sitelode.llm import decontamination, mixing, toolcalls, warc


def record_bytes(spark, rows):
    pages = spark.createDataFrame(rows, "page_id long, url string, html string, offset string")
    return [r.record.encode() + b"\r\n\r\n" for r in warc.records(pages).collect()]


def test_warc_round_trip(spark):
    rows = [(3, "http://a/", "<p>é</p>", "x"), (1, "u\r\nv", "<p>é</p>", "x"), (2, None, None, "x"), (5, "u", "", "x"), (None, "u", "<p>é</p>", "x"), (7, "u", "WARC/1.1\r\n\r\n", "x"), (1, "u", "<p>é</p>", "x")]
    path = warc.write(spark.createDataFrame(rows, "page_id long, url string, html string, offset string"), records_per_file=2)
    got = warc.read(spark, path, with_payload=True).collect()
    assert not [r for r in got if r.gap] and len(got) == len(rows)
    kind = sorted((r.page_id if r.page_id is not None else -1, r.record_type, r.refers_to) for r in got)
    assert kind == [(-1, "response", None), (1, "response", None), (1, "response", None), (2, "response", None), (3, "revisit", 1), (5, "revisit", 2), (7, "response", None)]
    html = {i: (h or "").encode() for i, _, h, _ in rows}
    for r in got:
        assert r.payload_bytes == len(html[r.page_id]) and r.payload_digest == base64.b32encode(hashlib.sha1(html[r.page_id]).digest()).decode()
        assert r.payload == (html[r.page_id] if r.record_type == "response" else b"")
    assert warc.read(spark, path).where("gap IS NOT NULL").count() == 0


@pytest.mark.parametrize("zipped", [False, True])
def test_salvage_recovers_later_records(spark, zipped):
    raw = record_bytes(spark, [(i, "u", f"<p>page {i} " + "x" * 50, "") for i in range(5)])
    parts = [gzip.compress(r) for r in raw] if zipped else raw
    damaged = bytearray(b"".join(parts))
    at = len(parts[0]) + len(parts[1]) - 20
    damaged[at : at + 6] = b"\0\0\0\0\0\0"  # inside the second record
    damaged = bytes(damaged[:-10])  # and the last one has no end
    out = list(warc.salvage(damaged))
    records = [r for r in out if isinstance(r, warc.Record)]
    gaps = [g for g in out if isinstance(g, warc.Gap)]
    assert len(records) == 3 and [g.offset for g in gaps] == [len(parts[0]), sum(map(len, parts[:4]))]
    assert sum(r.length for r in records) + sum(g.length for g in gaps) == len(damaged)
    assert list(warc.salvage(b"")) == [] and [type(x) for x in warc.salvage(b"junk")] == [warc.Gap]


def test_damage_of_a_written_archive_costs_one_record(spark, tmp_path):
    pages = spark.createDataFrame([(i, "u", f"<p>page {i} é " + "x" * 50) for i in range(7)], "page_id long, url string, html string").coalesce(1)
    path = warc.write(pages, str(tmp_path / "warc"), records_per_file=5)
    files = sorted((tmp_path / "warc").glob("part-*"))
    assert len(files) == 2 and not [r for f in files for r in warc.salvage(f.read_bytes()) if isinstance(r, warc.Gap)]
    assert sorted(r.page_id for r in warc.read(spark, path).collect()) == list(range(7))
    data = bytearray(files[0].read_bytes())
    members = [r.offset for r in warc.salvage(bytes(data))]
    assert len(set(members)) == 5 and gzip.decompress(data).count(b"WARC/1.1") == 5
    data[members[1] + 40] ^= 0xFF
    assert [r.offset for r in warc.salvage(bytes(data)) if isinstance(r, warc.Record)] == [members[0], *members[2:]]
    big = next(warc._members(iter([pa.record_batch({"record": ["a" * (1 << 24)]})]), 5, 1)).column(0)[0].as_py()
    assert len(gzip.decompress(big + b"\0")) == (1 << 24) + 4


def test_records_before_damage_within_a_member_are_recovered(spark):
    raw = record_bytes(spark, [(i, "u", f"<p>page {i} " + "x" * 50, "") for i in range(20)])
    whole = gzip.compress(b"".join(raw))
    bad_crc = bytearray(whole)
    bad_crc[-6] ^= 0xFF
    assert len([r for r in warc.salvage(bytes(bad_crc)) if isinstance(r, warc.Record)]) == 20
    assert [r for r in warc.salvage(gzip.compress(b"") + whole) if isinstance(r, warc.Gap)] == []
    pack = zlib.compressobj(6, zlib.DEFLATED, 31)
    head = pack.compress(b"".join(raw[:9])) + pack.flush(zlib.Z_FULL_FLUSH)
    found = list(warc.salvage(head + b"\xff" * 20))
    assert len([r for r in found if isinstance(r, warc.Record)]) == 9 and isinstance(found[-1], warc.Gap)


def calls_of(spark, rows):
    return spark.createDataFrame(rows, "conv_id long, place long, call_id string, name string, arguments string, needs array<string>")


def test_tool_calls(spark):
    schema = {"f": {"type": "object", "required": ["n"], "properties": {"n": {"type": "integer", "minimum": 1}, "tags": {"type": "array", "items": {"type": "string"}}}, "additionalProperties": False}}
    rows = [
        (1, 0, "a", "f", '{"n": 2.0, "tags": ["é"]}', []), (1, 1, "b", "f", '{"n": 0, "x": 1}', ["a", "gone"]), (1, 2, "c", "f", "not json", ["b", "a"]), (1, 3, "d", "g", "{}", ["d"]),
        (1, 4, "e", "f", None, None), (1, 5, None, "f", '{"n": 1}', []), (1, 9, "a", "f", '{"n": 9}', []),
    ]
    results = spark.createDataFrame([("a", 5, "one"), ("a", 6, "two"), ("z", 7, "lost"), (None, 8, "none")], "call_id string, place long, content string")
    got = {r.call_id: r for r in toolcalls.link(calls_of(spark, rows), results, schema).collect()}
    assert {k: r.level for k, r in got.items()} == {"a": 0, "b": 1, "c": 2, "d": None, "e": 0, None: 0}
    assert got["a"].json == '{"arguments":{"n":2,"tags":["é"]},"id":"a","name":"f","result":"one"}' and got["a"].copies == 2 and got["a"].valid
    assert got["b"].errors == ["$.n: too small", "$.x: not allowed"] and got["c"].errors == ["$: not JSON"] and got["e"].errors == ["$: no arguments"]
    assert got["d"].status == "cycle" and got["d"].errors == ["$: unknown tool"] and got["b"].status == "no result" and got["a"].status == "ok"
    assert [r.call_id for r in toolcalls.orphans(calls_of(spark, rows), results).collect()] == ["z"]
    assert all(json.loads(r.json)["id"] == k for k, r in got.items())
    assert toolcalls.link(calls_of(spark, []), results, schema).count() == 0


def test_identifiers_are_those_of_a_conversation(spark):
    rows = [(c, 0, "call_1", "f", '{"n": %d}' % i, []) for i, c in enumerate((1, 2, None))] + [(2, 1, "call_2", "f", "{}", ["call_1"]), (1, 1, "call_3", "f", "{}", ["call_2"])]
    results = spark.createDataFrame([(2, "call_1", 5, "two"), (1, "call_1", 6, "one"), (1, "call_2", 7, "lost"), (None, "call_1", 8, "none")], "conv_id long, call_id string, place long, content string")
    got = sorted((r.conv_id or 0, r.call_id, r.level, r.copies, json.loads(r.json)["result"], r.arguments) for r in toolcalls.link(calls_of(spark, rows), results, {}).collect())
    assert got == [(0, "call_1", 0, 1, "none", '{"n": 2}'), (1, "call_1", 0, 1, "one", '{"n": 0}'), (1, "call_3", 0, 1, None, "{}"), (2, "call_1", 0, 1, "two", '{"n": 1}'), (2, "call_2", 1, 1, None, "{}")]
    assert [(r.conv_id, r.call_id) for r in toolcalls.orphans(calls_of(spark, rows), results).collect()] == [(1, "call_2")]


def test_levels_have_no_greatest_number(spark):
    edges = spark.createDataFrame([(str(i + 1), str(i)) for i in range(104)], "call_id string, needs string").coalesce(1)
    assert {int(r.call_id): r.level for r in toolcalls.levels(edges).collect()} == {i: i for i in range(105)}


def test_levels_match_brute_force(spark):
    rng = random.Random(9)
    edges = {(f"n{a}", f"n{b}") for a, b in ((rng.randrange(60), rng.randrange(60)) for _ in range(70))}
    needs = {}
    for a, b in edges:
        needs.setdefault(a, set()).add(b)

    def level(x, seen=()):
        if x in seen:
            return None
        below = [level(y, (*seen, x)) for y in needs.get(x, ())]
        return None if None in below else max(below, default=-1) + 1

    want = {x: level(x) for e in edges for x in e}
    got = {r.call_id: r.level for r in toolcalls.levels(spark.createDataFrame(sorted(edges), "call_id string, needs string")).collect()}
    assert got == {x: n for x, n in want.items() if n is not None} and None in want.values()


def test_arguments_that_are_no_json(spark):
    bad = ["[" * 100_000, '{"n":"\\ud800"}', '{"n":1e400}', '{"n":NaN}', '{"n":-Infinity}', '{"n":1,"n":2}', "", "{", "[" * 900 + "]" * 900, '{"n": 1' + "0" * 5000 + "}"]
    good = ['{"n":1}', '{"n":1e3}', '{"n":"' + "x" * 200_000 + '"}', "[]", '"\\ud83d\\ude00"']
    rows = [(1, i, f"c{i}", "f", x, None) for i, x in enumerate(bad + good)]
    calls = calls_of(spark, rows).withColumn("level", decontamination.F.lit("clash")).withColumn("key", decontamination.F.lit(1)).withColumn("answers", decontamination.F.lit(1))
    results = spark.createDataFrame([], "call_id string, place long, content string, status string")
    got = {r.place: r for r in toolcalls.link(calls, results, {"f": {}}).collect()}
    assert len(got) == len(rows)
    refused = {i for i, r in got.items() if r.errors == ["$: not JSON"]}
    assert set(range(8)) <= refused <= set(range(len(bad))) and all(got[i].valid for i in range(len(bad), len(rows)))
    assert json.loads(got[len(bad) + 1].json)["arguments"] == {"n": 1000} and all(json.loads(r.json)["id"] == r.call_id for r in got.values())


def test_damage_never_raises_and_costs_few_records(spark):
    rng = random.Random(12)
    raw = record_bytes(spark, [(i, "u", f"<p>page {i} é " + "x" * rng.randrange(400), "") for i in range(60)])
    for whole in (b"".join(gzip.compress(r, mtime=0) for r in raw), b"".join(raw)):
        for _ in range(60):
            data = bytearray(whole)
            at = rng.randrange(len(data))
            data[at : at + 4] = rng.randbytes(4)
            found = list(warc.salvage(bytes(data)))
            records = [r for r in found if isinstance(r, warc.Record)]
            assert len(records) >= 58
            for r in found:
                assert r.offset >= 0 and (r.length >= 0)


def test_numbers_that_fit_nowhere_are_gaps_or_null(spark, tmp_path):
    (record,) = record_bytes(spark, [(7, "u", "abc", "")])
    odd = record.replace(b"Content-Length: ", b"Content-Length: " + b"9" * 5000, 1) if record.index(b"Content-Length") else record
    names = record.replace(b"page:7>", b"page:--5>")
    far = record.replace(b"page:7>", b"page:" + b"9" * 30 + b">")
    (tmp_path / "a.warc").write_bytes(odd + names + far + b"WARC/1.1\r\nContent-Length: -1\r\n\r\n" + record)
    got = warc.read(spark, str(tmp_path)).orderBy("offset").collect()
    assert [r.page_id for r in got if r.gap is None][-1] == 7 and any(r.gap for r in got) and len([r for r in got if r.gap is None]) >= 3


def test_turns_become_calls(spark):
    turns = [(1, 0, "system", "be brief"), (1, 1, "user", "hi there"), (1, 2, "assistant", "yes"), (1, 3, "user", None), (2, 0, "user", "alone"), (1, 1, "user", "hi there"), (None, 0, "user", "x")]
    conv = spark.createDataFrame(turns, "conv_id long, turn long, role string, text string")
    got = {r.call_id: r for r in toolcalls.link(*toolcalls.of_turns(conv), toolcalls.SCHEMAS).collect()}
    assert (got["call-1-1"].level, got["call-1-1"].status, got["call-1-1"].copies) == (1, "ok", 2)
    assert not got["call-1-3"].valid and got["call-2-0"].status == "no result" and got["call-1-0"].level == 0


def test_mixing_equals_its_sql(spark):
    rows = [(i, " ".join(["w"] * (i % 37)), "abcde"[i % 5] if i % 11 else None, "x") for i in range(400)] + [(None, "a b", "a", "x"), (1, None, "zero", "x"), (5, "again a", "a", "x"), (5, "again a", "a", "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string, target string")
    got = mixing.mix(docs).toPandas().sort_values(["doc_id", "size", "target"]).reset_index(drop=True)
    con = duckdb.connect()
    con.register("documents", docs.toArrow())
    want = con.sql(mixing.ORACLE).df().sort_values(["doc_id", "size", "target"]).reset_index(drop=True)[list(got.columns)]
    assert len(got) == len(rows) and (got.fillna(-1) - want.fillna(-1)).abs().max().max() < 1e-6
    assert (got.taken <= 3 * got["size"]).all() and abs(got.taken.sum() - got["size"].sum()) < 20
    assert mixing.mix(docs).orderBy("doc_id", "size", "target").collect() == mixing.mix(docs).orderBy("doc_id", "size", "target").collect()
    assert mixing.mix(docs.limit(0)).count() == 0


def test_water_level(spark):
    got = {r.source: r.target for r in mixing.targets(spark.createDataFrame([("a", 1), ("b", 10), (None, 100), ("c", 0)], "source string, source_size long")).collect()}
    assert got == {"a": 3.0, "b": 30.0, "c": 0.0, None: 78.0}


def test_hot_payloads_are_not_shuffled(spark):
    rows = [(i, f"u{i}", "hot" if i % 3 else f"own {i % 900}") for i in range(6000)] + [(None, "n", "hot"), (7000, "z", None), (6999, "y", "")]
    pages = spark.createDataFrame(rows, "page_id long, url string, html string")
    got = {r.page_id: (r.record_type, r.refers_to) for r in warc.read(spark, warc.write(pages)).where("gap IS NULL").collect() if r.page_id is not None}
    first = {}
    for i, _, html in rows:
        if i is not None:
            first[html or ""] = min(first.get(html or "", i), i)
    assert got == {i: ("response", None) if first[h or ""] == i else ("revisit", first[h or ""]) for i, _, h in rows if i is not None}
    plan = warc.records(pages)._jdf.queryExecution().executedPlan().toString()
    assert "BroadcastHashJoin" in plan


def test_decontamination(spark):
    bench = spark.createDataFrame([(1, "Ann has 5 apples and 5 pears. How many fruits does Ann have after 3 hours?"), (2, "short one"), (3, None), (4, ""), (1, None)], "item_id long, text string")
    rows = [
        (1, "x y z. Bob has 7 apples and 7 pears. How many fruits does Bob have after 9 minutes? the end"),  # other values
        (2, "Bob has 7 apples and 8 pears. How many fruits does Bob have after 9 minutes?"),  # inconsistent
        (3, "Ann has 5 apples and 5 pears. How many fruits does Ann have after 3 hours?"), (3, "Ann has 5 apples and 5 pears. How many fruits does Ann have after 3 hours?"),
        (4, "a short, one"), (5, None), (6, ""), (None, "nothing of the kind in here"),
    ]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    for limit in (1_000_000, 0):  # broadcast, and not
        got = sorted((r.doc_id or 0, r.contaminated, r["items"], r.reworded) for r in decontamination.contaminated(docs, bench, broadcast_rows=limit).collect())
        assert got == [(0, False, [], False), (1, True, [1], True), (2, False, [], False), (3, True, [1], False), (3, True, [1], False), (4, True, [2], False), (5, False, [], False), (6, False, [], False)]
    assert not any(r.contaminated for r in decontamination.contaminated(docs, bench.limit(0)).collect())


def test_decontamination_of_numbers(spark):
    many = " ".join(str(i * 37 % 1009) for i in range(40_000))
    words = "the train left at noon and came back again late"
    bench = spark.createDataFrame([(1, " ".join(str(i) for i in range(400))), (2, words + " " + " ".join(str(i) for i in range(200))), (3, "5 kg 6 kg 7 kg"), (4, "Sum 5 then 6 and 5 to get the result")], "item_id long, text string")
    rows = [(1, many), (2, words + " " + many), (3, "x " + words + " " + " ".join(str(i) for i in range(200))), (4, "Sum 7 then 8 and 7 to get the result"), (5, "Sum 7 then 8 and 9 to get the result"), (6, "5 kg 6 kg 7 kg")]
    start = time.monotonic()
    got = {r.doc_id: (r["items"], r.reworded) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), bench).collect()}
    assert got == {1: ([], False), 2: ([2], True), 3: ([2], False), 4: ([4], True), 5: ([], False), 6: ([], False)}
    assert time.monotonic() - start < 60


def test_decontamination_whatever_the_case(spark):
    item = "The tall engineer Ann Lee met Ann Lee near Oslo, then drove 40 km home before the rain came."
    bench = spark.createDataFrame([(1, item)], "item_id long, text string")
    other = item.replace("Ann Lee", "Bob Ray").replace("Oslo", "Rome")
    docs = spark.createDataFrame(list(enumerate([item, item.upper(), item.lower(), f"And so. {other}", item.replace("near Oslo", "near Lee"), "quite another text " * 9])), "doc_id long, text string")
    got = sorted((r.doc_id, r.contaminated, r.reworded) for r in decontamination.contaminated(docs, bench).collect())
    assert got == [(0, True, False), (1, True, False), (2, True, False), (3, True, True), (4, False, False), (5, False, False)]


def test_pipeline_stages_take_effect(spark):
    sf = "/root/testdata/sf0.001"
    docs = spark.read.parquet(f"{sf}/documents.parquet")
    names, counts = docs.columns, [docs.count()]
    for name, stage in corpus_pipeline.STAGES:
        docs = stage(spark, docs, sf)
        if name != "mix":
            assert docs.columns == names
        docs = spark.createDataFrame(docs.toPandas(), docs.schema)
        counts.append(docs.count())
    assert counts == sorted(counts, reverse=True) and counts[-1] == counts[-2] > 0 and counts[0] > counts[-1]


def test_decontamination_looks_at_all_places_and_all_texts_of_an_item(spark):
    item = "Ann has 5 apples and 5 pears. How many fruits does Ann have after 3 hours?"
    other = "Bob has 7 apples and 8 pears. How many fruits does Bob have after 9 minutes?"
    bench = spark.createDataFrame([(1, item), (1, "Quite another question of the very same item, isn't it?"), (2, "zzz yyy xxx")], "item_id long, text string")
    rows = [(1, f"{other} And then, as was said before: {item}"), (2, f"{other} {other}"), (3, "well, quite another question of the very same item, isn't it, so"), (4, f"{item} {other}")]
    docs = spark.createDataFrame([(*r, "u", "f", 1) for r in rows], "doc_id long, text string, uid string, form string, h int")
    got = {r.doc_id: (r.contaminated, r["items"], r.reworded) for r in decontamination.contaminated(docs, bench).collect()}
    assert got == {1: (True, [1], False), 2: (False, [], False), 3: (True, [1], False), 4: (True, [1], False)}


def test_decontamination_of_names_that_begin_sentences(spark):
    item = "Natalia sold 48 clips in the morning. Natalia then gave away half of what she had left. Natalia wants to know how many clips are there now?"
    other = item.replace("Natalia", "Marek").replace("48", "36")
    mixed = item.replace("Natalia", "Marek", 2).replace("48", "36")
    rows = [(1, item), (2, other), (3, mixed), (4, "So. " + other.upper()), (5, item.lower()), (6, "Here is a text. It has a few sentences. None of them is like it.")]
    got = {r.doc_id: (r.contaminated, r.reworded) for r in decontamination.contaminated(spark.createDataFrame(rows, "doc_id long, text string"), spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got == {1: (True, False), 2: (True, True), 3: (False, False), 4: (False, False), 5: (True, False), 6: (False, False)}


def brute_items(text, items, size=5):
    """Ids of items of plain words of which 80 % of the windows are in a text."""
    tokens = lambda t: [w for w in (x.strip(decontamination._ENDS) for x in t.lower().split(" ")) if w]
    windows = lambda t: {tuple(t[i : i + min(size, len(t))]) for i in range(max(len(t) - size, 0) + 1)}
    own = tokens(text)
    out = []
    for i, t in items:
        t = tokens(t)
        want = windows(t)
        have = windows(own) if len(t) >= size else {tuple(own[j : j + len(t)]) for j in range(len(own))}
        if t and len(want & have) >= 0.8 * len(want):
            out.append(i)
    return out


def test_decontamination_of_plain_words_matches_brute_force(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet").selectExpr("doc_id", "lower(regexp_replace(text, '[^a-zA-Z ]', ' ')) AS text")
    bench = spark.read.parquet("/root/testdata/sf0.001/benchmark.parquet").selectExpr("item_id", "lower(regexp_replace(text, '[^a-zA-Z ]', ' ')) AS text")
    items = [tuple(r) for r in bench.collect()]
    got = {r.doc_id: r["items"] for r in decontamination.contaminated(docs, bench).collect()}
    want = {r.doc_id: brute_items(r.text or "", items) for r in docs.collect()}
    assert got == want and any(want.values())


@pytest.fixture()
def own_tables(spark, tmp_path):
    spark.createDataFrame([(1, 0, 0), (None, 1, 1)], "doc_id long, quality int, toxic int").write.parquet(f"{tmp_path}/labels.parquet")
    spark.createDataFrame([(1, "the quick brown fox jumps over a lazy dog in the park")], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    return str(tmp_path)


def test_pipeline_stages_on_odd_rows(spark, own_tables):
    columns = "doc_id long, text string, lang string, source string, n_chars long, uid string, node string, form string, score string"
    text = "some words of a plain text that says nothing at all about anything here"
    row = lambda i, t, lang="en": (i, t, lang, None, None, "uid", "node", "form", "score")
    rows = [row(1, text), row(1, text), row(1, "another text of the same id, and " + " ".join("abcdefghij")), row(None, text), row(2, text), row(3, None), row(4, ""), row(5, "12 34"), row(6, "We saw: the quick brown fox jumps over a lazy dog in the park."), row(7, "long " * 100_000 + text)]
    docs = spark.createDataFrame(rows, columns)
    stages = dict(corpus_pipeline.STAGES)
    ids = lambda df: sorted((r.doc_id or 0, len(r.text or "")) for r in df.collect())
    everything = ids(docs)
    assert ids(stages["language"](spark, docs, own_tables)) == sorted(ids(docs.where("doc_id IS NULL OR doc_id NOT IN (3, 4, 5)")))
    assert ids(stages["language"](spark, docs.withColumn("lang", decontamination.F.lit(None).cast("string")), own_tables)) == ids(docs.where("doc_id IS NULL OR doc_id NOT IN (3, 4, 5)"))
    assert ids(stages["toxicity"](spark, docs, own_tables)) == everything
    one_each = ids(stages["near_duplicates"](spark, docs, own_tables))
    assert one_each == sorted([(1, len(text)), (1, len(rows[2][1])), (3, 0), (5, 5), (6, len(rows[8][1])), (7, len(rows[9][1]))])
    clean = stages["decontamination"](spark, docs, own_tables)
    assert ids(clean) == sorted(ids(docs.where("doc_id IS NULL OR doc_id <> 6"))) and {r.uid for r in clean.collect()} == {"uid"}
    mixed = stages["mix"](spark, docs, own_tables)
    assert mixed.count() == len(rows) and mixed.columns == ["doc_id", "size", "source_size", "target", "taken"]
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), own_tables).count() == 0, name
        if name != "mix":
            assert stage(spark, docs, own_tables).columns == docs.columns
