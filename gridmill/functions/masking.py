"""Masking and digests of personal columns."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F


def mask_email(
    email: Column | str, allow: Sequence[str] = (), domain: str = "@company.com"
) -> Column:
    """Make an address undeliverable unless it is on the allow list. NULL stays NULL."""
    c = _col(email)
    masked = F.concat(F.replace(c, F.lit("@"), F.lit("_at_")), F.lit(domain))
    return F.when(c.isin(list(allow)), c).otherwise(masked) if allow else masked


def mask_secret(
    user: Column | str, secret: Column | str, salt: str, allow: Sequence[str] = ()
) -> Column:
    """One-way keyed hash of the secret unless the user is on the allow list.

    A random salt could never repeat its result, so the salt is a parameter. Salt and user
    are led by their lengths: no other user and secret run together to the same text.
    """
    u, s = _col(user), _col(secret)
    led = lambda c: F.concat(F.octet_length(c).cast("string"), F.lit(":"), c)
    hashed = F.sha2(F.concat(led(F.lit(salt)), led(u), s), 256)
    return F.when(u.isin(list(allow)), s).otherwise(hashed) if allow else hashed


def md5_pair(secret: Column | str, user: Column | str) -> Column:
    """The stored form 'md5' + md5(secret + user)."""
    return F.concat(F.lit("md5"), F.md5(F.concat(_col(secret), _col(user))))


def _col(c: Column | str) -> Column:
    return F.col(c) if isinstance(c, str) else c
