"""Queries do their whole job: what a cut would leave out is in these small tables."""

from pyspark.sql import functions as F

from corpusgrid.llm import chat_format, toxicity


def test_chat_digests_need_every_example_whole(spark, monkeypatch):
    rows = [(c, t, "assistant" if t % 2 else "user", f"text {c} {t} <|im_end|>\n") for c in (1, 2) for t in range(7)]
    formatted = chat_format.format_turns(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string"))
    sound = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    assert all(r.n_examples == 3 and r.n_turns == 7 and r.formatted_chars > r.loss_chars for r in sound.values())
    expand = chat_format.expand

    def without_context(*args, **more):
        hurt = (F.col("conv_id") == 2) & (F.col("example") == 2)
        return expand(*args, **more).withColumn("prompt", F.when(hurt, F.lit("<|im_start|>assistant\n")).otherwise(F.col("prompt")))

    monkeypatch.setattr(chat_format, "expand", without_context)
    found = {r.conv_id: r for r in chat_format.digests(formatted).collect()}
    assert found[1] == sound[1] and found[2].n_examples < 3 and found[2].loss_sha256 != sound[2].loss_sha256


def test_every_window_is_compressed(monkeypatch):
    toxic = [w for i in range(40) for w in toxicity.windows(f"calm words and zuxif number{i}")]
    ordinary = [w for i in range(40) for w in toxicity.windows(f"calm words and other number{i} things")]
    trained = toxicity.train(toxic, ordinary).open()
    seen, codes = [], toxicity._codes
    monkeypatch.setattr(toxicity, "_codes", lambda found: seen.extend(found) or codes(found))
    trained.features(["unheard zuxifka calm qqq unheard", "calm again"])
    assert sorted(seen) == [b"again", b"calm", b"qqq", b"unheard", b"zuxifka"]
    assert set(trained._known) == set(seen)
