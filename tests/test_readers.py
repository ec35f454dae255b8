"""S1-S13 on an inline corpus written to temporary files."""

import json
import os

import pytest
from pyspark.sql import functions as F

from tuneframe.sources import index
from tuneframe.sources import readers as S


def write(path, data: bytes):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    with open(path, "wb") as f:
        f.write(data)
    return path


def recs(df):
    return [(r.idx, json.loads(r.raw)) for r in df.orderBy("idx").collect()]


def test_jsonl_skips_blank_and_malformed_and_wraps_scalars(spark, tmp_dir):
    lines = [
        b'{"a": 1}',
        b"",
        b"   ",
        b"not json",
        b"[1, 2]",
        b"7",
        b'{"k": 1, "k": 2}',
        b'{"x": null}',
        b'{"t": "caf\xff\xe2\x82"}',
        b"{NaN}",
        b'  {"s": " padded "}  ',
    ]
    p = write(f"{tmp_dir}/d.jsonl", b"\n".join(lines) + b"\n")
    got = recs(S.read_jsonl(spark, p))
    assert [i for i, _ in got] == list(range(7))
    assert got[0][1] == {"a": 1}
    assert got[1][1] == {"value": [1, 2]}
    assert got[2][1] == {"value": 7}
    assert got[3][1] == {"k": 2}  # duplicate key: last wins
    assert got[4][1] == {"x": None}
    assert got[5][1]["t"] == "caf��"  # invalid bytes -> U+FFFD
    assert got[6][1] == {"s": " padded "}


def test_missing_key_differs_from_null(spark, tmp_dir):
    p = write(f"{tmp_dir}/d.jsonl", b'{"x": null}\n{}\n')
    df = S.read_jsonl(spark, p).select("idx", F.expr("try_variant_get(v, '$.x', 'variant') IS NOT NULL").alias("has_x"))
    assert [r.has_x for r in df.orderBy("idx").collect()] == [True, False]


def test_json_document_wrappers(spark, tmp_dir):
    p1 = write(f"{tmp_dir}/a/list.json", json.dumps([{"a": 1}, 2]).encode())
    p2 = write(f"{tmp_dir}/b/wrap.json", json.dumps({"meta": 1, "examples": [{"b": 1}, {"b": 2}]}).encode())
    p3 = write(f"{tmp_dir}/c/one.json", json.dumps({"instruction": "hi", "output": "yo"}).encode())
    p4 = write(f"{tmp_dir}/d/scalar.json", b"3")
    assert recs(S.read_json(spark, p1)) == [(0, {"a": 1}), (1, {"value": 2})]
    assert recs(S.read_json(spark, p2)) == [(0, {"b": 1}), (1, {"b": 2})]
    assert recs(S.read_json(spark, p3)) == [(0, {"instruction": "hi", "output": "yo"})]
    assert recs(S.read_json(spark, p4)) == []


def test_csv_all_strings_quoted_newlines_short_rows(spark, tmp_dir):
    p = write(f"{tmp_dir}/d.csv", b'instruction,output\n"multi\nline",42\nonly\n')
    got = recs(S.read_csv(spark, p))
    assert got[0][1] == {"instruction": "multi\nline", "output": "42"}
    assert got[1][1]["instruction"] == "only"


def test_txt_lines_keep_inner_spaces(spark, tmp_dir):
    p = write(f"{tmp_dir}/d.txt", b"  first line \n\n   \nsecond\n")
    got = recs(S.read_txt(spark, p))
    assert got == [(0, {"text": "  first line "}), (1, {"text": "second"})]


def test_parquet_null_columns_are_present_keys(spark, tmp_dir):
    spark.createDataFrame([("a", None)], "text string, extra string").write.parquet(f"{tmp_dir}/p")
    df = S.read_parquet(spark, f"{tmp_dir}/p")
    r = df.select(F.expr("try_variant_get(v, '$.extra', 'variant') IS NOT NULL").alias("h")).collect()
    assert r[0].h is True


def test_dispatch_rejects_unknown_suffix(spark):
    with pytest.raises(ValueError, match="Supported"):
        S.read_dataset(spark, "/x/data.xml")


def test_dense_index_over_many_files_and_splits(spark, tmp_dir):
    # three files, each split into several partitions by a tiny split size
    total = 0
    for f in range(3):
        rows = [json.dumps({"f": f, "i": i}) if i % 5 else "garbage" for i in range(400)]
        write(f"{tmp_dir}/many/part-{f}.jsonl", ("\n".join(rows) + "\n").encode())
        total += sum(1 for i in range(400) if i % 5)
    old = spark.conf.get("spark.sql.files.maxPartitionBytes")
    spark.conf.set("spark.sql.files.maxPartitionBytes", "2048")
    try:
        df = S.read_jsonl(spark, f"{tmp_dir}/many")
        got = [(r.idx, json.loads(r.raw)) for r in df.collect()]
    finally:
        spark.conf.set("spark.sql.files.maxPartitionBytes", old)
    got.sort()
    assert [i for i, _ in got] == list(range(total))
    order = [(d["f"], d["i"]) for _, d in got]
    assert order == sorted(order)


def test_preview_and_strict_reader(spark, tmp_dir):
    p = write(f"{tmp_dir}/d.jsonl", b'{"a": 1}\n{"a": 2}\n{"a": 3}\n')
    assert S.preview(S.read_jsonl(spark, p), 2).count() == 2
    bad = write(f"{tmp_dir}/bad/d.jsonl", b'{"a": 1}\nnot json\n')
    with pytest.raises(Exception):
        S.read_training_records(spark, bad).collect()


def test_jsonl_sink_roundtrip(spark, tmp_dir):
    df = spark.createDataFrame(
        [([("user", "héllo"), ("assistant", "ok")],)], "messages array<struct<role:string,content:string>>"
    )
    S.write_jsonl(df, f"{tmp_dir}/out")
    back = S.read_jsonl(spark, f"{tmp_dir}/out")
    assert json.loads(back.collect()[0].raw) == {"messages": [{"role": "user", "content": "héllo"}, {"role": "assistant", "content": "ok"}]}


def test_strict_reader_takes_no_bare_object(spark, tmp_dir):
    for name, doc, want in (("bare", {"text": "x"}, 0), ("data", {"data": [{"text": "x"}, {"text": "y"}]}, 2), ("list", [{"text": "x"}], 1)):
        path = os.path.join(tmp_dir, f"{name}.json")
        with open(path, "w") as f:
            json.dump(doc, f)
        assert S.read_training_records(spark, path).count() == want
    assert S.read_json(spark, os.path.join(tmp_dir, "bare.json")).count() == 1


def test_elements_keep_key_order_and_spacing(spark, tmp_dir):
    doc = ' [ {"b" : 1,  "a":[1,  2]} ,7,\n"x y",{"é": "\\u00e9"} ] '
    p = write(f"{tmp_dir}/a/list.json", doc.encode())
    got = S.read_json(spark, p).orderBy("idx").collect()
    assert [r.raw for r in got] == ['{"b" : 1,  "a":[1,  2]}', '{"value":7}', '{"value":"x y"}', '{"é": "\\u00e9"}']
    p = write(f"{tmp_dir}/b/one.json", b'\n{"z": 1 , "data": {"a": 2}}\n')
    assert [r.raw for r in S.read_json(spark, p).collect()] == ['{"z": 1 , "data": {"a": 2}}']


def test_element_slices():
    def slices(doc, keys=("data", "rows"), bare=True):
        return [doc[a:b] for a, b in S.element_slices(doc, list(keys), bare)]

    assert slices("[]") == slices(" [ ] ") == slices("3") == slices('{"data": []}') == []
    assert slices("{}") == ["{}"] and slices("{}", bare=False) == []
    assert slices('{"rows": [1], "data": [2, 3]}') == ["2", "3"]  # the first wrapper key by preference, not by place
    assert slices('{"data": [1], "data": 5, "rows": [9]}') == ["9"]  # the last of equal keys counts
    assert slices('{"data": [[1], {"data": [2]}]}') == ["[1]", '{"data": [2]}']
    for bad in ("", "[1", "[1,]", "[,1]", '{"a"}', '{"a": 1,}', "[1] 2", "{1: 2}", "[NaN]", '{"data": [1}'):
        with pytest.raises(ValueError):
            slices(bad)


def test_many_documents_are_indexed_in_file_order(spark, tmp_dir):
    for f in range(12):
        write(f"{tmp_dir}/many/{f:02d}.json", json.dumps([{"f": f, "i": i} for i in range(f)]).encode())
    write(f"{tmp_dir}/many/05b.json", b"[broken")
    got = recs(S.read_json(spark, f"{tmp_dir}/many"))
    assert [i for i, _ in got] == list(range(66))
    assert [(d["f"], d["i"]) for _, d in got] == [(f, i) for f in range(12) for i in range(f)]
    with pytest.raises(Exception, match="comma|delimiter|Expecting|broken|value"):
        S.read_json(spark, f"{tmp_dir}/many", strict=True).count()


def test_csv_short_rows_have_nulls(spark, tmp_dir):
    p = write(f"{tmp_dir}/d.csv", b'a,b,c\n1,,3\n1\n1,\n"x, ""y""",2\n1,2,3,4\n,,\n"",,""\n')
    got = [d for _, d in recs(S.read_csv(spark, p))]
    assert got == [{"a": "1", "b": "", "c": "3"}, {"a": "1", "b": None, "c": None}, {"a": "1", "b": "", "c": None},
                   {"a": 'x, "y"', "b": "2", "c": None}, {"a": "1", "b": "2", "c": "3"}, {"a": "", "b": "", "c": ""}, {"a": "", "b": "", "c": ""}]


def test_preview_as_chat(spark, tmp_dir):
    p = write(f"{tmp_dir}/d.jsonl", b'{"instruction": "q", "output": "a"}\n{"text": "t"}\n{"messages": 7}\n')
    df = S.read_jsonl(spark, p)
    got = [[(m.role, m.content) for m in r.messages] for r in S.preview(df, 3, as_="chat").orderBy("idx").collect()]
    assert got == [[("user", "q"), ("assistant", "a")], [("user", "t")], []]
    with pytest.raises(ValueError, match="raw or chat"):
        S.preview(df, 3, as_="table")


def test_index_scans_the_input_once(spark, tmp_dir):
    p = write(f"{tmp_dir}/d.jsonl", b'{"a": 1}\n{"a": 2}\n')
    plan = S.read_jsonl(spark, p)._jdf.queryExecution().executedPlan().toString()
    assert "FileScan" not in plan and "parse_json" not in plan


def test_records_are_indexed_where_they_lie(spark, tmp_dir, monkeypatch):
    """F11 of round 3: every reading of the records moved them all to their offsets."""
    for i in range(3):
        write(f"{tmp_dir}/d/{i}.jsonl", b"".join(b'{"a": %d}\n' % (i * 10 + j) for j in range(5)))
    want = [(i * 5 + j, {"a": i * 10 + j}) for i in range(3) for j in range(5)]
    # As for an input that is larger than the threshold.
    limit = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        df = S.read_jsonl(spark, f"{tmp_dir}/d")
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastHashJoin" in plan and "SortMergeJoin" not in plan
        assert recs(df) == want
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", limit)
    monkeypatch.setattr(index, "BROADCAST_SPLITS", 2)
    assert recs(S.read_jsonl(spark, f"{tmp_dir}/d")) == want
