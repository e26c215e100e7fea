"""Envelope encryption with keys from a provider.

Every text is sealed with a data key of its batch, and the data key with the provider's key; the envelope,
``enc:v2:KEY_ID:VERSION:WRAPPED:SEALED``, holds both. The plan names a provider, never a key: tasks ask the
provider, and keys exist there as values of a column only, for the JVM's AES. Keys turn by wrapping data
keys again (``rewrapped``); sealed texts stay as they are.
"""

from __future__ import annotations

import os
import re
from collections.abc import Iterator
from dataclasses import dataclass, field

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from corpusgrid.errors import GridError
from corpusgrid.operators.privacy import key_bytes

ENVELOPE = "enc:v2:"
_ID = re.compile(r"[A-Za-z0-9._-]{1,64}")
OPERATIONS, ALGORITHM = ("encrypt", "decrypt", "rewrap"), "AES-256-GCM"


class Provider:
    """Where keys come from. It is sent to tasks, so it holds places of keys, not keys."""

    name = "provider"

    def versions(self, key_id: str) -> dict[int, str]:
        """The material of each version of a key; none if it is unknown."""
        raise NotImplementedError

    def key_ids(self) -> list[str]:
        raise NotImplementedError

    def key(self, key_id: str, version: int | None = None) -> tuple[bytes, int]:
        """A key of 32 bytes and its version, the latest if none is named."""
        held = self.versions(key_id)
        wanted = max(held, default=None) if version is None else version
        if wanted not in held:
            raise GridError("KEY_UNAVAILABLE", f"privacy key unavailable: {key_id}")
        return key_bytes(held[wanted]), wanted

    def capabilities(self) -> dict:
        return {"provider": self.name, "operations": list(OPERATIONS), "algorithms": [ALGORITHM], "key_ids": self.key_ids()}


@dataclass
class FileKeys(Provider):
    """A YAML file on a shared path: ``keys: {ID: value}``, ``{ID: {value: v}}`` or ``{ID: {versions: {1: v, 2: w}}}``."""

    path: str
    name: str = "file"

    def _keys(self) -> dict:
        import yaml

        try:
            with open(self.path, encoding="utf-8") as file:
                said = yaml.safe_load(file) or {}
        except (OSError, yaml.YAMLError) as error:
            raise GridError("KEY_UNAVAILABLE", f"cannot read the key file: {type(error).__name__}") from error
        return said.get("keys") or {}

    def versions(self, key_id: str) -> dict[int, str]:
        held = self._keys().get(key_id)
        if isinstance(held, dict):
            return {int(v): str(m) for v, m in held["versions"].items()} if "versions" in held else {1: str(held["value"])} if held.get("value") else {}
        return {1: str(held)} if held else {}

    def key_ids(self) -> list[str]:
        return sorted(map(str, self._keys()))

    def warning(self) -> str | None:
        """A file that others than its owner may read."""
        return "KEY_FILE_INSECURE" if os.stat(self.path).st_mode & 0o077 else None


@dataclass
class EnvironmentKeys(Provider):
    """Variables ``PREFIX`` + the id in capitals of the tasks' environment; another version has its number behind ``_V``."""

    prefix: str = "CORPUSGRID_KEY_"
    known: list[str] = field(default_factory=list)
    name: str = "environment"

    def versions(self, key_id: str) -> dict[int, str]:
        stem = self.prefix + re.sub("[^A-Z0-9]", "_", key_id.upper())
        found = {1: os.environ[stem]} if os.environ.get(stem) else {}
        later = {int(n[len(stem) + 2 :]): v for n, v in os.environ.items() if n.startswith(f"{stem}_V") and n[len(stem) + 2 :].isdigit() and v}
        return found | later

    def key_ids(self) -> list[str]:
        return sorted(self.known)


def _check(provider: Provider, key_id: str, operation: str) -> None:
    able = provider.capabilities()
    if operation not in able["operations"] or ALGORITHM not in able["algorithms"]:
        raise GridError("KEY_UNAVAILABLE", f"provider {provider.name} cannot {operation}")
    if not _ID.fullmatch(key_id):
        raise GridError("DIRECTIVE_INVALID", f"{key_id!r} is no key id")


def _asked(call, schema: str, column: Column) -> Column:
    """A vectorised column whose values a task makes once: evaluating it twice would give other keys."""

    def run(batches: Iterator[pd.Series]) -> Iterator[pd.DataFrame]:
        yield from map(call, batches)

    return F.pandas_udf(run, schema).asNondeterministic()(column)


def _base64(x: Column) -> Column:
    return F.regexp_replace(F.base64(x), r"\s", "")


def _aes(text: Column, key: Column) -> Column:
    return F.aes_encrypt(text, key, F.lit("GCM"), F.lit("DEFAULT"))


def sealed(df, column: str, provider: Provider, key_id: str):
    """``df`` with a text column sealed; nulls stay."""
    _check(provider, key_id, "encrypt")

    def keys(batch: pd.Series) -> pd.DataFrame:
        master, version = provider.key(key_id)
        return pd.DataFrame({"data": [os.urandom(32)] * len(batch), "master": [master] * len(batch), "version": version})

    held = df.withColumn("_keys", _asked(keys, "data binary, master binary, version int", F.col(column)))
    wrapped, box = _aes(F.col("_keys.data"), F.col("_keys.master")), _aes(F.col(column).cast("binary"), F.col("_keys.data"))
    made = F.concat(F.lit(f"{ENVELOPE}{key_id}:"), F.col("_keys.version").cast("string"), F.lit(":"), _base64(wrapped), F.lit(":"), _base64(box))
    return held.withColumn(column, F.when(F.col(column).isNotNull(), made)).drop("_keys")


def _masters(provider: Provider, newest: bool):
    """A call that gives each envelope its key, and with ``newest`` the key that is to wrap it from now on. What is
    no envelope, or one whose key is gone, has none."""

    def keys(batch: pd.Series) -> pd.DataFrame:
        seen: dict[tuple[str, int | None], tuple[bytes | None, int]] = {}

        def of(key_id: str, version: int | None) -> tuple[bytes | None, int]:
            if (key_id, version) not in seen:
                try:
                    seen[key_id, version] = provider.key(key_id, version)
                except GridError:
                    seen[key_id, version] = None, 0
            return seen[key_id, version]

        rows = []
        for text in batch:
            parts = text.split(":", 4) if isinstance(text, str) and text.startswith(ENVELOPE) else []
            whole = len(parts) == 5 and parts[3].isdigit()
            master, _ = of(parts[2], int(parts[3])) if whole else (None, 0)
            fresh, version = of(parts[2], None) if whole and newest else (None, 0)
            rows.append((master, fresh, version))
        return pd.DataFrame(rows, columns=["master", "fresh", "version"])

    return keys


_MASTERS = "master binary, fresh binary, version int"


def _part(text: Column, n: int) -> Column:
    return F.split_part(text, F.lit(":"), F.lit(n))


def _data_key(text: Column, master: Column) -> Column:
    return F.try_aes_decrypt(F.unbase64(_part(text, 5)), master, F.lit("GCM"), F.lit("DEFAULT"))


def opened(df, column: str, provider: Provider):
    """``df`` with its envelopes opened: other texts stay, envelopes that are broken or whose key is gone give null."""
    _check(provider, "any", "decrypt")
    held = df.withColumn("_keys", _asked(_masters(provider, False), _MASTERS, F.col(column)))
    text = F.col(column)
    plain = F.try_aes_decrypt(F.unbase64(_part(text, 6)), _data_key(text, F.col("_keys.master")), F.lit("GCM"), F.lit("DEFAULT")).cast("string")
    return held.withColumn(column, F.when(F.startswith(text, F.lit(ENVELOPE)), plain).otherwise(text)).drop("_keys")


def rewrapped(df, column: str, provider: Provider):
    """``df`` with each envelope's data key wrapped by the newest version of its key; the sealed texts are the same.
    Envelopes whose old key is gone, and other texts, stay."""
    _check(provider, "any", "rewrap")
    held = df.withColumn("_keys", _asked(_masters(provider, True), _MASTERS, F.col(column)))
    text, data = F.col(column), _data_key(F.col(column), F.col("_keys.master"))
    made = F.concat(F.lit(ENVELOPE), _part(text, 3), F.lit(":"), F.col("_keys.version").cast("string"), F.lit(":"), _base64(_aes(data, F.col("_keys.fresh"))), F.lit(":"), _part(text, 6))
    return held.withColumn(column, F.coalesce(F.when(F.startswith(text, F.lit(ENVELOPE)), made), text)).drop("_keys")
