"""Encryption at rest with Spark's AES-GCM functions."""

from __future__ import annotations

import hashlib

from pyspark.sql import Column, SparkSession
from pyspark.sql import functions as F

from billsift import constants as K

PBKDF2_ROUNDS = 480_000


def derive_key(passphrase: bytes, salt: bytes, rounds: int = PBKDF2_ROUNDS) -> bytes:
    """A 256-bit key; run once on the driver, never per row."""
    return hashlib.pbkdf2_hmac("sha256", passphrase, salt, rounds, dklen=32)


def key_column(spark: SparkSession, key: bytes) -> Column:
    """The key as a one-row scalar subquery, so that no plan string shows it."""
    return spark.createDataFrame([(bytearray(key),)], "k binary").scalar()


def encrypt(text: Column, key: Column) -> Column:
    """Blank or null text gives empty bytes; all else a fresh-nonce GCM token."""
    blank = text.isNull() | (text == "")
    return F.when(blank, F.lit(b"")).otherwise(F.aes_encrypt(text, key, F.lit("GCM")))


def decrypt(token: Column, key: Column) -> Column:
    """Empty token gives blank text; a bad one gives a marker, not a failure."""
    plain = F.try_aes_decrypt(token, key, F.lit("GCM")).cast("string")
    blank = token.isNull() | (F.octet_length(token) == 0)
    return F.when(blank, F.lit("")).otherwise(F.coalesce(plain, F.lit(K.DECRYPTION_FAILED)))
