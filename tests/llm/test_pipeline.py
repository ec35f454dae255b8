"""The pipeline, stage by stage, against brute force."""

import re
from collections import Counter, defaultdict

import pytest

import corpus_pipeline as P
from tests.conftest import SF001
from tests.llm.test_text_ops import brute_classes
from tuneframe.llm import mixing
from tuneframe.llm.common import scratch, table

BLANK = " \t\n\x0b\x0c\r"
FOLD = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
WORD = re.compile(r"[^\x20\x09-\x0D]+")


@pytest.fixture(scope="module")
def steps(spark):
    docs = [table(spark, SF001, "documents")]
    for name, stage in P.STAGES:
        path = scratch(spark, "test-stage")
        stage(spark, docs[-1], SF001).write.parquet(path)
        docs.append(spark.read.parquet(path))
    return docs


def test_stages_keep_the_columns(steps):
    for d in steps[1:-1]:
        assert d.columns == steps[0].columns


def test_toxic_documents_go(spark, steps):
    toxic = {r["doc_id"]: r["toxic"] for r in table(spark, SF001, "labels").collect()}
    before, after = ({r["doc_id"]: r["text"] for r in d.collect()} for d in steps[:2])
    assert all(after[i] == before[i] for i in after)
    labelled = [(i in after) == (not y) for i, y in toxic.items()]
    assert sum(labelled) / len(labelled) > 0.95


def test_lines_equal_brute_force(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[1].collect()]
    holders = defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            k = line.strip(BLANK).translate(FOLD)
            if len(k) >= 40:
                holders[k].add(i)
    want = {}
    for i, t in rows:
        want[i] = "\n".join(x for x in (t or "").split("\n") if not (
            len(h := holders.get(x.strip(BLANK).translate(FOLD), ())) >= 5 and max(h) != i))
    assert {r["doc_id"]: r["text"] for r in steps[2].collect()} == want
    assert all(r["n_chars"] == len(r["text"]) for r in steps[2].collect())


def test_one_of_each_class_stays(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[2].collect()]
    want = {i for i, _, c in brute_classes(rows, 5, 80) if i == c}
    assert sorted(r["doc_id"] for r in steps[3].collect()) == sorted(want)


def test_mix_holds_the_words_taken(steps):
    taken, _ = mixing.mix(steps[3], block=P.MIX_BLOCK)
    want = {r["id"]: r["taken"] for r in taken.collect() if r["taken"]}
    got = Counter()
    texts = {r["doc_id"]: r["text"] for r in steps[3].collect()}
    for r in steps[4].collect():
        words = WORD.findall(r["text"])
        got[r["doc_id"]] += len(words)
        assert not Counter(words) - Counter(WORD.findall(texts[r["doc_id"]]))
    assert dict(got) == want


def test_passes_cut_at_stretches():
    text = " ".join(f"w{k}" for k in range(10))

    def take(turn, start, words, shard=0):
        return {"turn": turn, "start": start, "words": words, "shard": shard}

    assert mixing.passes(text, [take(0, 0, 4), take(0, 4, 4), take(0, 8, 2)]) == [(0, None, text)]
    assert mixing.passes(text, [take(1, 8, 2), take(0, 0, 10), take(1, 0, 4)]) == [(0, None, text), (1, None, "w0 w1 w2 w3\nw8 w9")]
    by_shard = mixing.passes(text, [take(0, 0, 4, 3), take(0, 4, 6, 5), take(1, 2, 2, 5)], by_shard=True)
    assert by_shard == [(0, 3, "w0 w1 w2 w3"), (0, 5, "w4 w5 w6 w7 w8 w9"), (1, 5, "w2 w3")]
    assert mixing.passes(text, []) == []



def test_packing_of_the_mix(steps):
    rows = [(r["doc_id"], r["text"]) for r in steps[4].collect()]
    pieces = steps[5].collect()


    per = defaultdict(list)
    for r in pieces:
        per[r["sequence_id"]].append((r["offset"], r["length"]))
    for spans in per.values():
        at = 0
        for o, n in sorted(spans):
            assert o == at
            at += n
        assert at <= 4096
    assert {r["doc_id"] for r in pieces} == {i for i, _ in rows}
    assert sum(r["length"] for r in pieces if r["start"] == 0) > 0



def test_run_equals_the_stages(spark, steps):
    want = sorted((r["doc_id"], r["start"], r["ids_crc32"], r["length"]) for r in steps[-1].collect())
    got = sorted((r["doc_id"], r["start"], r["ids_crc32"], r["length"]) for r in P.run(spark, SF001).collect())
    assert got == want
