"""Additively homomorphic (Paillier) encrypted sums over a DataFrame.

Enc(m) = g^m · r^n mod n²; the product of ciphertexts decrypts to the sum of the
plaintexts. A group is a party: it sums its own rows with an ordinary aggregation and
encrypts that one number, so there is one encryption per party however many rows there
are. The product of the parties' ciphertexts is the encrypted total. Only the key
holder can decrypt.

Values are non-negative integers (scale floats to fixed point first). Key
generation and management are outside this library: keys are inputs.
"""

from __future__ import annotations

import secrets
from dataclasses import dataclass
from math import gcd

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


@dataclass(frozen=True)
class PublicKey:
    n: int

    @property
    def n2(self) -> int:
        return self.n * self.n

    @property
    def g(self) -> int:
        return self.n + 1


@dataclass(frozen=True)
class PrivateKey:
    public: PublicKey
    lam: int
    mu: int

    @classmethod
    def from_primes(cls, p: int, q: int) -> "PrivateKey":
        n = p * q
        lam = (p - 1) * (q - 1) // gcd(p - 1, q - 1)
        pk = PublicKey(n)
        mu = pow(_L(pow(pk.g, lam, pk.n2), n), -1, n)
        return cls(pk, lam, mu)

    def decrypt(self, c: int) -> int:
        n = self.public.n
        return (_L(pow(c, self.lam, self.public.n2), n) * self.mu) % n


def _L(x: int, n: int) -> int:
    return (x - 1) // n


def encrypt(pk: PublicKey, m: int) -> int:
    while True:
        r = secrets.randbelow(pk.n)
        if r > 0 and gcd(r, pk.n) == 1:
            break
    # g = n + 1 ⇒ g^m = 1 + m·n (mod n²)
    return ((1 + m * pk.n) % pk.n2) * pow(r, pk.n, pk.n2) % pk.n2


def encrypted_sums(df: DataFrame, value: str, pk: PublicKey, group_cols: list[str] | None = None) -> DataFrame:
    """Per group: the ciphertext of Σ value (decimal string) and the row count. Nulls add nothing but count as rows."""
    g = list(group_cols or [])
    v = F.col(value).cast("decimal(20,0)")
    checked = F.when(v < 0, F.raise_error(F.lit("Paillier sums take non-negative integers (use fixed point)"))).otherwise(v)
    sums = df.groupBy(*g).agg(F.coalesce(F.sum(checked), F.lit(0)).cast("string").alias("_sum"), F.count(F.lit(1)).alias("n"))
    cipher = F.pandas_udf(lambda totals: totals.map(lambda t: str(encrypt(pk, int(t)))), "string")
    return sums.select(*g, cipher("_sum").alias("cipher"), "n")


def total_cipher(sums: DataFrame, pk: PublicKey) -> int:
    """The ciphertext of the sum over all parties: the product of their ciphertexts (one row per party)."""
    c = 1
    for r in sums.select("cipher").toLocalIterator():
        c = c * int(r["cipher"]) % pk.n2
    return c


def decrypt_frame(sums: DataFrame, sk: PrivateKey) -> list[tuple]:
    """Key holder side: decrypt the (small, one row per group) totals."""
    return [(*r[:-2], sk.decrypt(int(r["cipher"])), r["n"]) for r in sums.collect()]
