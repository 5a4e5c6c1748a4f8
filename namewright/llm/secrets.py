"""Operator 1, secret scan: patterns plus a token-efficiency test.

A random string is cut by a BPE vocabulary into many short tokens, while words, even
unknown ones, keep longer ones. Runs of key-like characters whose characters-per-token
ratio is low are reported, after known digests and identifiers are excluded. A run needs
letters and digits, or letters whose case changes; one that base spans cover, but for
fewer than 8 characters, is not reported again.

Edge cases: a null or empty text gives no span; a null key stays a row; repeated rows
are scanned one by one; any text length is scanned whole; an empty table gives an empty
one; columns other than the two named are not read.
"""

from __future__ import annotations

import base64
import hashlib
import re
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from namewright.llm.common import documents, prepare, text_of

#: Fixed values of the base patterns; kinds in the order in which spans at one start are listed.
ASSIGN = r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]+"
HEX = r"[0-9a-f]+"
KINDS = ("assign", "access", "hex", "random")

#: A run that base spans cover but for fewer characters than this is theirs, not a key of its own.
MORE = 8
RUN = r"[A-Za-z0-9+/_=-]{%d,}"
DIGEST = re.compile(r"(?:md5|sha\d+|sha\d+)?[-_=/]?(?:[0-9a-f]{32}|[0-9a-f]{40}|[0-9a-f]{56}|[0-9a-f]{64}|[0-9a-f]{96}|[0-9a-f]{128}|[0-9A-F]{32}|[0-9A-F]{40}|[0-9A-F]{64})")
IDENTIFIER = re.compile(
    r"(?i:[0-9a-f]{8}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{4}-[0-9a-f]{12})"  # UUID
    r"|[0-9A-HJKMNP-TV-Z]{26}"  # ULID
    r"|[-+_/=0-9]+"  # numbers, dates, phones, rules
    r"|[A-Za-z]{1,6}[-_]?[0-9-]+"  # prefixed record numbers
    r"|(?:[A-Za-z]{2,}|[0-9]{1,4})(?:[-_/=+]+(?:[A-Za-z]{2,}|[0-9]{1,4}))+"  # slugs and paths
)
SCHEMA = "row_key bigint, n_assign bigint, n_access bigint, n_hex bigint, n_random bigint, spans array<struct<kind:string,start:int,end:int,ratio:double>>, base_sha256 string, span_list string"


@lru_cache(maxsize=2)
def vocabulary(path: str):
    import public_tokenizers
    import tiktoken

    with open(path, "rb") as f:
        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}
    return tiktoken.Encoding("secrets", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def looks_random(run: str, encoding, most_ratio: float) -> float | None:
    """The characters-per-token ratio where it exposes a random string, else None."""
    if DIGEST.fullmatch(run) or IDENTIFIER.fullmatch(run):
        return None
    mixed = re.search("[0-9]", run) and re.search("[A-Za-z]", run) or len(re.findall("[a-z][A-Z]", run)) > 1
    if not mixed or len(set(run)) < 8:
        return None  # letters of one case are words of some language, a capital or two begin names
    ratio = len(run) / len(encoding.encode_ordinary(run))
    return ratio if ratio <= most_ratio else None


def uncovered(start: int, end: int, base: list[tuple[int, int]], first: int) -> int:
    """How many positions of [start, end) lie in no span of ``base`` (sorted), those before ``first`` left out."""
    n, at = 0, start
    while first < len(base) and base[first][0] < end:
        a, b = base[first]
        n, at, first = n + max(0, a - at), max(at, b), first + 1
    return n + max(0, end - at)


def scan(text: str | None, encoding, least: int, most_ratio: float) -> list[tuple[str, int, int, float | None]]:
    """All spans of one text, by start, then kind."""
    text = text or ""
    found = []
    for m in re.finditer(ASSIGN, text, re.IGNORECASE | re.ASCII):
        if len(m[2]) >= 6:
            found.append(("assign", m.start(), m.end(), None))
    found += [("access", m.start(), m.end(), None) for m in re.finditer(ACCESS, text) if m.end() - m.start() >= 20]
    found += [("hex", m.start(), m.end(), None) for m in re.finditer(r"[0-9a-f]{24,}", text)]
    base = sorted((a, b) for _, a, b, _ in found)
    i = 0
    for m in re.finditer(RUN % least, text):
        while i < len(base) and base[i][1] <= m.start():
            i += 1
        if uncovered(m.start(), m.end(), base, i) < MORE:
            continue  # reported already
        if (ratio := looks_random(m[0].strip("=-_/+"), encoding, most_ratio)) is not None:
            found.append(("random", m.start(), m.end(), ratio))
    return sorted(found, key=lambda x: (x[1], KINDS.index(x[0])))


def listed(spans) -> str:
    return ",".join(f"{k}:{a}:{b}" for k, a, b, _ in spans)


def find_secrets(df: DataFrame, key: str = "doc_id", text: str = "text", vocabulary_path: str | None = None, least: int = 20, most_ratio: float = 2.0) -> DataFrame:
    """One row per input row: counts by kind, the spans (code points, end exclusive) and digests.

    ``vocabulary_path``: a tiktoken rank file, the installed public one if None.
    ``least`` characters make a run worth testing; at ``most_ratio`` characters a token or
    fewer it counts as random. Needs one pass over the texts and no shuffle.
    """
    prepare(df.sparkSession)

    def op(batches):
        import public_tokenizers

        encoding = vocabulary(vocabulary_path or public_tokenizers.path("byte_bpe_50k.tiktoken"))
        for batch in batches:
            rows = []
            for k, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                spans = scan(t, encoding, least, most_ratio)
                n = {kind: sum(s[0] == kind for s in spans) for kind in KINDS}
                rows.append(
                    {
                        "row_key": k, "n_assign": n["assign"], "n_access": n["access"], "n_hex": n["hex"], "n_random": n["random"],
                        "spans": [dict(zip(("kind", "start", "end", "ratio"), s, strict=True)) for s in spans],
                        "base_sha256": hashlib.sha256(listed(s for s in spans if s[0] != "random").encode()).hexdigest(), "span_list": listed(spans),
                    }
                )
            if rows:
                yield pa.RecordBatch.from_pylist(rows, schema=OUT)

    out = df.select(F.col(key).cast("bigint").alias("row_key"), text_of(text).alias("text")).mapInArrow(op, SCHEMA)
    return out.withColumnRenamed("row_key", key)


OUT = pa.schema(
    [("row_key", pa.int64()), *((f"n_{k}", pa.int64()) for k in ("assign", "access", "hex", "random")), ("spans", pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32()), ("ratio", pa.float64())]))), ("base_sha256", pa.string()), ("span_list", pa.string())]
)


def op1_secret_scan(spark, sf_dir):
    """Contract 1 over all documents."""
    found = find_secrets(documents(spark, sf_dir))
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", F.col("span_list").alias("spans"), "n_random")
