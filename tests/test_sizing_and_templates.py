"""Z4 by one merged order, Z5's override, G1's sensors; K1 by templates, K9 both ways."""

import random

import pytest
from pyspark.sql import functions as F

from tuneframe.operators import sizing as Z
from tuneframe.operators import telemetry as G
from tuneframe.operators import tokens as K

VRAM = "repo_id string, param_count long, method string, dtype string, total_estimated_gb double"


def fleet(spark, rnd, n=40):
    rows = [(i % 7, i, 1024.0 * rnd.choice([0, 4, 8, 24, 24]), float(rnd.randint(0, 8000))) for i in range(n)] + [(9, 99, None, 1.0)]
    return spark.createDataFrame(rows, "host long, device long, memory_total_mib double, memory_used_mib double")


def needs(spark, rnd, n=300):
    rows = [(f"m{i}", rnd.randint(1, 99), *rnd.choice(Z.method_dtype_grid()), rnd.choice([2.0, 4.0, round(rnd.random() * 30, 2)])) for i in range(n)]
    return spark.createDataFrame(rows, VRAM)


def test_fits_equal_all_pairs(spark):
    rnd = random.Random(2)
    dev, vram = fleet(spark, rnd), needs(spark, rnd)
    free = [(r.host, r.device, r.free_gb) for r in Z.free_memory(dev).collect() if r.free_gb is not None]
    rows = vram.collect()
    for width in (0.25, 100.0):
        got = Z.fit_devices(vram, dev, width=width)
        plan = got._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        want = set()
        for h, d, gb in free:
            for m, t in Z.method_dtype_grid():
                fits = [r.param_count for r in rows if (r.method, r.dtype) == (m, t) and r.total_estimated_gb <= gb]
                want.add((h, d, m, t, len(fits), max(fits, default=None)))
        assert {(r.host, r.device, r.method, r.dtype, r.models_that_fit, r.largest_param_count) for r in got.collect()} == want
        est = Z.fit_hosts(vram, dev, width=width)
        plan = est._jdf.queryExecution().executedPlan().toString()
        assert "NestedLoop" not in plan and "Cartesian" not in plan
        for r in est.collect():
            fits = [gb for _, _, gb in free if r.total_estimated_gb <= gb]
            assert (r.devices_that_fit, r.smallest_free_gb) == (len(fits), min(fits, default=None))
    assert Z.fit_hosts(vram.limit(0), dev).count() == 0
    assert {r.devices_that_fit for r in Z.fit_hosts(vram, dev.limit(0)).collect()} == {0}


def test_method_override(spark):
    m = spark.createDataFrame([("a", 7_000_000_000)], "repo_id string, param_count long")
    assert Z.suggest_hyperparams(m, F.lit(24.0)).first().method == "lora"
    r = Z.suggest_hyperparams(m, F.lit(24.0), "qlora").first()
    assert (r.method, r.load_in_4bit, r.lora_r, r.lora_alpha) == ("qlora", True, 32, 64)
    assert "qlora" in r.rationale
    with pytest.raises(ValueError, match="prefix"):
        Z.suggest_hyperparams(m, F.lit(24.0), "prefix")


def test_missing_sensors_are_null(spark):
    rows = [(1.0, "h", 5.0, 64, 32, [(0, "g", 1.0, 1048576, 2097152, 1000.0, 50.0)])]
    gpu = "index int, name string, utilization_pct double, memory_used_bytes long, memory_total_bytes long, power_mw double, temperature_c double"
    df = spark.createDataFrame(rows, f"ts double, host string, cpu_pct double, ram_total long, ram_available long, gpus array<struct<{gpu.replace(' ', ':').replace(',:', ',')}>>")
    r = G.device_rows(df).first()
    assert (r.power_w, r.power_limit_w, r.fan_speed_pct, r.disk_used_gb, r.disk_total_gb) == (1.0, None, None, None, None)
    # All readings pass a hash aggregate; only what is left of them is sorted by device.
    plan = G.latest_devices(G.device_rows(df))._jdf.queryExecution().executedPlan().toString()
    assert plan.rindex("HashAggregate(keys=[host") > plan.rindex("SortAggregate(key=[host")
    later = rows + [(2.0, "h", 5.0, 64, 32, [(0, "renamed", 9.0, 1048576, 2097152, 3000.0, 50.0)])]
    r = G.latest_devices(G.device_rows(spark.createDataFrame(later, df.schema))).collect()
    assert [(x.name, x.ts, x.utilization_pct, x.power_w) for x in r] == [("renamed", 2.0, 9.0, 3.0)]


def messages(spark, rows):
    return spark.createDataFrame([(i, m) for i, m in enumerate(rows)], "idx long, messages array<struct<role:string,content:string>>")


def test_templates_equal_strings_written_by_hand(spark):
    rows = [
        [("system", " be brief "), ("user", " hi "), ("assistant", "hello "), ("user", "bye")],
        [("user", "q"), ("assistant", "a")],
        [("assistant", "lost"), ("user", "q"), ("tool", "t")],
        [("system", "s")],
        [],
        [("user", None), (None, "x")],
    ]
    df = messages(spark, rows)

    def prompts(template, ask):
        return [r.p for r in df.select("idx", K.render(F.col("messages"), ask, template=template).alias("p")).orderBy("idx").collect()]

    assert prompts(K.CHATML, True) == [
        "<|im_start|>system\n be brief <|im_end|>\n<|im_start|>user\n hi <|im_end|>\n<|im_start|>assistant\nhello <|im_end|>\n"
        "<|im_start|>user\nbye<|im_end|>\n<|im_start|>assistant\n",
        "<|im_start|>user\nq<|im_end|>\n<|im_start|>assistant\na<|im_end|>\n<|im_start|>assistant\n",
        "<|im_start|>assistant\nlost<|im_end|>\n<|im_start|>user\nq<|im_end|>\n<|im_start|>tool\nt<|im_end|>\n<|im_start|>assistant\n",
        "<|im_start|>system\ns<|im_end|>\n<|im_start|>assistant\n",
        "",
        "<|im_start|>user\n<|im_end|>\n<|im_start|>\nx<|im_end|>\n<|im_start|>assistant\n",
    ]
    assert prompts(K.INST, False) == [
        "<s>[INST] <<SYS>>\nbe brief\n<</SYS>>\n\nhi [/INST] hello </s><s>[INST] bye [/INST]",
        "<s>[INST] q [/INST] a </s>",
        " lost </s><s>[INST] q [/INST]",
        "",
        "",
        "<s>[INST]  [/INST]",
    ]
    custom = K.ChatTemplate(turns={"user": ("U:", ";")}, other=("{role}>", "|"), begin="^", generation="A:")
    assert prompts(custom, True)[0] == "^system> be brief |U: hi ;assistant>hello |U:bye;A:"


def test_a_template_is_one_expression(spark):
    df = messages(spark, [[("user", "q")]])
    plan = df.select(K.render(F.col("messages"), template=K.INST))._jdf.queryExecution().executedPlan().toString()
    assert "Python" not in plan and "Exchange" not in plan
    counted = K.token_counts(df, K.tokenizer_udf(lambda: lambda t: list(t.encode())), K.CHATML).first()
    assert counted.n_tokens == len(counted.prompt.encode()) and counted.prompt.startswith("<|im_start|>")


def test_lookup_by_token(spark):
    texts = spark.createDataFrame([(0, "b a b")], "idx long, text string")
    vocab = K.build_vocabulary(texts, specials=["<pad>"])
    asked = spark.createDataFrame([("a",), ("b",), ("zz",)], "token string")
    assert {r.token: r.id for r in K.lookup_tokens(vocab, asked).collect()} == {"b": 1, "a": 2, "zz": None}
    by_plugin = K.lookup_tokens(vocab, asked, K.tokenizer_udf(lambda: lambda t: list(t.encode())))
    assert {r.token: r.ids for r in by_plugin.collect()}["zz"] == [122, 122]
