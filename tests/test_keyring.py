"""Keys from a provider: envelopes, rotation, and plans that hold no key."""

import base64

import pytest
from pyspark.sql import functions as F

from corpusgrid.errors import GridError
from corpusgrid.operators import keyring, privacy
from corpusgrid.operators.keyring import EnvironmentKeys, FileKeys

SECRET, NEWER = "correct horse", "ab" * 32


@pytest.fixture
def keys(tmp_path):
    path = tmp_path / "keys.yaml"
    path.write_text(f"keys:\n  plain: {SECRET}\n  nested: {{value: other}}\n  turned: {{versions: {{1: {SECRET}}}}}\n")
    path.chmod(0o600)
    return FileKeys(str(path))


def texts(spark):
    return spark.createDataFrame([(i, t) for i, t in enumerate(["one", "", "déjà vu", None, "x" * 50_000, "enc:v2:broken"])], "id long, body string").repartition(3)


def test_round_trip_and_nothing_of_a_key_in_the_plan(spark, keys):
    sealed = keyring.sealed(texts(spark), "body", keys, "plain")
    rows = {r.id: r.body for r in sealed.collect()}
    assert rows[3] is None and all(t.startswith("enc:v2:plain:1:") for i, t in rows.items() if i != 3) and not any("déjà" in (t or "") or "x" * 9 in (t or "") for t in rows.values())
    key = privacy.key_bytes(SECRET)
    plan = sealed._jdf.queryExecution().toString()
    for shape in (SECRET, key.hex(), key.hex().upper(), base64.b64encode(key).decode()):
        assert shape not in plan
    back = keyring.opened(spark.createDataFrame([(i, t) for i, t in rows.items()], "id long, body string"), "body", keys)
    assert {r.id: r.body for r in back.collect()} == {r.id: r.body for r in texts(spark).collect()}
    # sealed and opened in one plan: data keys are drawn once
    assert {r.id: r.body for r in keyring.opened(sealed, "body", keys).collect()} == {r.id: r.body for r in texts(spark).collect()}


def test_keys_turn_without_touching_the_texts(spark, keys):
    held = spark.createDataFrame(keyring.sealed(texts(spark), "body", keys, "turned").collect(), "id long, body string")
    with open(keys.path, "w") as file:
        file.write(f"keys:\n  turned: {{versions: {{1: {SECRET}, 2: {NEWER}}}}}\n")
    turned = {r.id: r.body for r in keyring.rewrapped(held, "body", keys).collect()}
    was = {r.id: r.body for r in held.collect()}
    for i, text in turned.items():
        if text is not None:
            assert text.startswith("enc:v2:turned:2:") and text.split(":")[5] == was[i].split(":")[5] and text.split(":")[4] != was[i].split(":")[4]
    with open(keys.path, "w") as file:
        file.write(f"keys:\n  turned: {{versions: {{2: {NEWER}}}}}\n")
    now = spark.createDataFrame(list(turned.items()), "id long, body string")
    assert {r.id: r.body for r in keyring.opened(now, "body", keys).collect()} == {r.id: r.body for r in texts(spark).collect()}
    assert {r.body for r in keyring.opened(held, "body", keys).collect()} == {None}  # the old version is gone
    assert {r.id: r.body for r in keyring.rewrapped(held, "body", keys).collect()} == was


def test_providers_say_what_they_can(spark, keys, monkeypatch):
    assert keys.capabilities() == {"provider": "file", "operations": ["encrypt", "decrypt", "rewrap"], "algorithms": ["AES-256-GCM"], "key_ids": ["nested", "plain", "turned"]}
    assert keys.key("nested") == (privacy.key_bytes("other"), 1) and keys.warning() is None
    import os

    os.chmod(keys.path, 0o644)
    assert keys.warning() == "KEY_FILE_INSECURE"
    monkeypatch.setenv("CORPUSGRID_KEY_MY_KEY", "first")
    monkeypatch.setenv("CORPUSGRID_KEY_MY_KEY_V3", "third")
    assert EnvironmentKeys().key("my-key") == (privacy.key_bytes("third"), 3) and EnvironmentKeys().key("my-key", 1)[0] == privacy.key_bytes("first")

    class Reader(FileKeys):
        def capabilities(self):
            return super().capabilities() | {"operations": ["decrypt"]}

    for bad in (lambda: keys.key("absent"), lambda: keys.key("plain", 2), lambda: keyring.sealed(texts(spark), "body", Reader(keys.path), "plain"),
                lambda: keyring.sealed(texts(spark), "body", keys, "a:b"), lambda: FileKeys("/nowhere").key("x")):
        with pytest.raises(GridError):
            bad()


def test_directives_in_comments():
    body = 'a <!-- notes:hash key_id = "k" -->one<!-- /notes:hash --> b <!--notes:encrypt key_id="k"-->two<!--/notes:encrypt-->\n```\n<!-- notes:hash key_id="k" -->no<!-- /notes:hash -->\n```\n<!-- notes:tokenize key_id="k" -->open'
    spans, warnings = privacy.inline_spans(body, "notes", "comment")
    assert [(p, body[a:b]) for p, _, a, b in spans] == [("hash", "one"), ("encrypt", "two")] and warnings == ["unclosed directive tokenize"]
    assert privacy.inline_spans(body)[0] == []


def test_comments_are_protected(spark):
    key = bytes(range(32))
    df = spark.createDataFrame([('x <!-- notes:encrypt key_id="k" -->two<!-- /notes:encrypt -->',)], "body string")
    made = df.select(privacy.protect_inline(F.col("body"), {"k": key}, "notes", "comment").alias("body"))
    held = made.first().body
    assert ">two<" not in held and "enc:v1:" in held
    assert spark.createDataFrame([(held,)], "body string").select(privacy.reveal_inline(F.col("body"), key)).first()[0] == df.first().body
