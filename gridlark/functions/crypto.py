"""Pseudonyms, keyed digests and name-based ids as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Only for synthetic test tables. Real data needs a secret of its own.
SYNTHETIC_SALT = "synthetic-salt-for-test-tables-only-0001"


def require_secret(secret: str, size: int = 32) -> str:
    if len(secret) < size:
        raise ValueError(f"a secret needs {size} characters at least")
    return secret


def pseudonym(ip: Column, salt: str) -> Column:
    require_secret(salt)
    return F.concat(F.lit("src-"), F.substring(F.sha2(F.concat(F.lit(salt + "|"), ip), 256), 1, 12))


def network_prefix(ip: Column) -> Column:
    """/24 of an IPv4 address; other text is null (``sources.foreign.network_of`` knows IPv6)."""
    parts = F.split(ip, r"\.")
    ok = ip.rlike(r"^(25[0-5]|2[0-4]\d|1?\d?\d)(\.(25[0-5]|2[0-4]\d|1?\d?\d)){3}$")
    return F.when(ok, F.concat_ws(".", F.slice(parts, 1, 3)[0], F.slice(parts, 1, 3)[1], F.slice(parts, 1, 3)[2], F.lit("0/24")))


def session_key(*parts: Column) -> Column:
    return F.substring(F.sha2(F.concat_ws("|", *parts), 256), 1, 16)


def hmac_pads(secret: bytes) -> tuple[str, str]:
    if len(secret) > 64:
        import hashlib

        secret = hashlib.sha256(secret).digest()
    key = secret.ljust(64, b"\0")
    return bytes(b ^ 0x36 for b in key).hex(), bytes(b ^ 0x5C for b in key).hex()


def hmac_sha256(message: Column, secret: bytes) -> Column:
    """HMAC as two nested digests, hex."""
    inner, outer = hmac_pads(secret)
    first = F.sha2(F.concat(F.unhex(F.lit(inner)), message), 256)
    return F.sha2(F.concat(F.unhex(F.lit(outer)), F.unhex(first)), 256)


def fingerprint(source_ip: Column, protocol: Column, payload: Column, secret: bytes) -> Column:
    """Keyed digest of source, protocol and payload bytes, apart by a zero byte."""
    zero = F.unhex(F.lit("00"))
    return hmac_sha256(F.concat(F.encode(source_ip, "UTF-8"), zero, F.encode(protocol, "UTF-8"), zero, payload), secret)


def uuid5(namespace: str, name: Column) -> Column:
    """RFC 4122 version 5 of a UTF-8 name."""
    # bound to a name of its own: the digest is worked out once, inside lambdas and branches too
    digest = uuid5_digest(F.lit(namespace.replace("-", "")), name)
    return F.get(F.transform(F.array(digest), uuid5_of), F.lit(0))


def uuid5_digest(namespace_hex: Column, name: Column) -> Column:
    """The digest behind a version 5 id; as a column of its own it is worked out once."""
    return F.sha1(F.concat(F.unhex(namespace_hex), F.encode(name, "UTF-8")))


def uuid5_of(digest: Column) -> Column:
    variant = F.substring(F.lit("89ab"), F.conv(F.substring(digest, 17, 1), 16, 10).cast("int") % 4 + 1, F.lit(1))
    return F.concat_ws("-", F.substring(digest, 1, 8), F.substring(digest, 9, 4), F.concat(F.lit("5"), F.substring(digest, 14, 3)), F.concat(variant, F.substring(digest, 18, 3)), F.substring(digest, 21, 12))
