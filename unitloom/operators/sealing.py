"""Columns and nested values sealed under named slots, each with its own key: AES-GCM, bound to the place it was sealed at."""

from __future__ import annotations

import hashlib
import os
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from unitloom.operators.nested import LEAF, under
from unitloom.plans.spec import quoted

MIN_PASSPHRASE = 8


class SealError(ValueError):
    """A passphrase that is too short, a slot that is not open, an export of sealed values."""


@dataclass(frozen=True)
class Slot:
    """A key slot: a name and the salt of its key. scrypt derives keys."""

    name: str
    salt: bytes = field(default_factory=lambda: os.urandom(16))

    def key(self, passphrase: str) -> bytes:
        if len(passphrase) < MIN_PASSPHRASE:
            raise SealError(f"a passphrase has {MIN_PASSPHRASE} characters or more")
        return hashlib.scrypt(passphrase.encode(), salt=self.salt, n=1 << 14, r=8, p=1, maxmem=64 << 20, dklen=32)


@dataclass
class KeyRing:
    """Slots and the keys of those that are open. A declared slot keeps its salt: it is never declared anew."""

    slots: dict[str, Slot] = field(default_factory=dict)
    keys: dict[str, bytes] = field(default_factory=dict)

    def declare(self, name: str, passphrase: str) -> None:
        if name in self.slots and name not in self.keys:
            raise SealError(f"slot '{name}' exists; unlock it first")
        slot = self.slots.setdefault(name, Slot(name))
        self.keys[name] = slot.key(passphrase)

    def unlock(self, name: str, passphrase: str) -> None:
        if name not in self.slots:
            raise SealError(f"there is no slot '{name}'")
        self.keys[name] = self.slots[name].key(passphrase)

    def key(self, name: str) -> bytes:
        if name not in self.keys:
            raise SealError(f"slot '{name}' is locked")
        return self.keys[name]


def seal_text(text: Column, key: bytes, place: Column) -> Column:
    """Null stays null. The initialisation vector is drawn per value; ``place`` is authenticated along."""
    return F.when(text.isNotNull(), F.aes_encrypt(text.cast("binary"), F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), F.unhex(F.substring(F.sha2(F.concat(F.uuid().cast("binary")), 256), 1, 24)), place.cast("binary")))


def open_text(sealed: Column, key: bytes, place: Column) -> Column:
    """Null if the key or the place is wrong or a byte was changed."""
    return F.try_aes_decrypt(sealed, F.lit(key), F.lit("GCM"), F.lit("DEFAULT"), place.cast("binary")).cast("string")


def _place(slot: str, column: str, row: Column) -> Column:
    return F.concat_ws("/", F.lit(slot), F.lit(column), row.cast("string"))


def seal_columns(df: DataFrame, columns: list[str], slot: str, ring: KeyRing, row: str) -> DataFrame:
    """The columns as ciphertext, bound to slot, column and the row's key ``row``."""
    key = ring.key(slot)
    return df.select(*(seal_text(quoted(c).cast("string"), key, _place(slot, c, quoted(row))).alias(c) if c in columns else quoted(c) for c in df.columns))


def open_columns(df: DataFrame, types: dict[str, str], slot: str, ring: KeyRing, row: str) -> DataFrame:
    """Sealed columns with the types they had."""
    key = ring.key(slot)
    return df.select(*(open_text(quoted(c), key, _place(slot, c, quoted(row))).cast(types[c]).alias(c) if c in types else quoted(c) for c in df.columns))


def seal_paths(leaves: DataFrame, key: list[str], prefixes: list[str], slot: str, ring: KeyRing) -> tuple[DataFrame, DataFrame]:
    """Leaves that stay readable, and those at or below ``prefixes`` as one ciphertext each, with key, position and slot."""
    hit = F.lit(False)
    for p in prefixes:
        hit = hit | under(F.col("path"), p)
    place = F.concat_ws("/", F.lit(slot), *(F.col(k).cast("string") for k in key), F.col("pos").cast("string"))
    body = F.to_json(F.struct("path", "segs", "type", "text"))
    sealed = leaves.where(hit).select(*key, "pos", F.lit(slot).alias("slot"), seal_text(body, ring.key(slot), place).alias("sealed"))
    return leaves.where(~hit), sealed


def unseal_paths(public: DataFrame, sealed: DataFrame, key: list[str], slot: str, ring: KeyRing) -> tuple[DataFrame, DataFrame]:
    """Readable leaves with those of the slot back at their positions, and what other slots still hold."""
    place = F.concat_ws("/", F.lit(slot), *(F.col(k).cast("string") for k in key), F.col("pos").cast("string"))
    shape = "path string, segs array<struct<is_index:boolean,key:string,idx:int>>, type string, text string"
    mine = sealed.where(F.col("slot") == slot).select(*key, "pos", F.from_json(open_text(F.col("sealed"), ring.key(slot), place), shape).alias("x"))
    return public.unionByName(mine.select(*key, "pos", "x.path", "x.segs", "x.type", "x.text").select(*public.columns)), sealed.where(F.col("slot") != slot)


def locked(df: DataFrame) -> list[str]:
    """Columns that hold ciphertext; they are carried along as they are."""
    return [n for n, t in df.dtypes if t == "binary"]


def refuse_export(sealed: DataFrame) -> None:
    """An export with sealed values would lose them."""
    if sealed.limit(1).count():
        raise SealError("sealed values cannot be exported; unseal them first")


def encrypt_all(df: DataFrame, slot: str, ring: KeyRing, row: str, clear: tuple[str, ...] = ()) -> DataFrame:
    """Every column but the row key and those named sealed to one slot."""
    return seal_columns(df, [c for c in df.columns if c != row and c not in clear], slot, ring, row)


LEAVES = LEAF
