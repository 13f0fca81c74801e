"""Secret scans with corpus-wide ownership frequency.

A pattern can't tell a credential that leaked from one that every tutorial prints. The corpus can: candidates are hashed and
counted by distinct repositories and owners. What many owners share was copied from a common text; what one or two owners
have is theirs, and if it also looks drawn at random it is reported as live.

Shape of the job: one pass over the texts writes a narrow table (row, repository, owner, spans with a digest of each value);
texts and values go no further. The counts are three aggregates, each with a map-side part: (value, owner, repository), (value,
owner), (value); a value that a third of all rows repeat is a few rows a task. Verdicts go back to the spans by a join on
the digest, which Spark splits where a value is hot, and only rows with spans are grouped again.

Base kinds are always spans. The kinds in MORE are too broad to stand alone (any long token may be one): their candidates become
spans only where the corpus says that they are live.
"""

from __future__ import annotations

import hashlib
import math
import re
from collections import Counter
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import table, trimmed, written

#: Base kinds in their order: pattern, group of the value, least length of the value.
BASE = {
    "assign": (re.compile(r"(password|passwd|secret|token|api_?key)[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", re.IGNORECASE | re.ASCII), 2, 6),
    "access": (re.compile(r"AKIA[A-Z0-9]+"), 0, 20),
    "hex": (re.compile(r"(?<![0-9a-f])[0-9a-f]{24,}"), 0, 24),
}
#: Further kinds in their order: pattern, group of the value, a string that each match has.
MORE = {
    "pem": (re.compile(r"-----BEGIN (?:[A-Z0-9]+ ){0,3}PRIVATE KEY-----([A-Za-z0-9+/=\s]{40,})"), 1, "PRIVATE KEY-----"),
    "jwt": (re.compile(r"(?<![A-Za-z0-9_-])eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}(?:\.[A-Za-z0-9_-]+)?"), 0, "eyJ"),
    "vendor": (re.compile(r"(?<![A-Za-z0-9_-])(?:gh[oprsu]_|github_pat_|glpat-|xox[abprs]-|[rs]k_live_|sk-|AIza|ya29\.)[A-Za-z0-9_-]{16,256}"), 0, ""),
    "login": (re.compile(r"://[^\s/:@]{1,256}:([^\s/:@]{6,256})@"), 1, "://"),
    "random": (re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z0-9+/_-]{20,}={0,2}"), 0, ""),
}
KINDS = [*BASE, *MORE]
CUES = ("password", "passwd", "secret", "token", "apikey", "api_key")
#: Owners from which on a value counts as copied.
OWNERS = 3
#: Bits a character that a live value has at least, and the longest value of kind random: longer runs are data.
BITS, LONGEST = 2.5, 256
# Words that mark a value as a stand-in.
STAND_INS = ("example", "changeme", "placeholder", "your", "dummy", "sample", "xxxx", "0000000", "redacted", "insert", "1234567", "abcdefg")

_SPAN = T.StructType().add("start", "long").add("kind", "integer").add("end", "long").add("value_sha256", "string").add("looks_random", "boolean").add("stand_in", "boolean")


def bits(value: str) -> float:
    """Entropy of a value's characters."""
    n = len(value)
    return -sum(c / n * math.log2(c / n) for c in Counter(value).values()) if n else 0.0


def looks_random(value: str) -> bool:
    """Enough bits a character for its alphabet, and digits besides letters."""
    few = re.fullmatch(r"[0-9a-f]*|[0-9A-F]*|[0-9]*", value) is not None
    return bits(value) >= (BITS if few else BITS + 0.5) and any(c.isdigit() for c in value) and (few and len(value) >= 16 or any(c.isalpha() for c in value))


def candidates(text: str) -> list[tuple[int, int, int, str]]:
    """(start, kind's number, end, value) in code points, by start and kind. Base kinds: leftmost non-overlapping matches, short values dropped afterwards."""
    out, low = [], text.lower()
    for k, (kind, (pattern, group, least)) in enumerate(BASE.items()):
        if kind == "assign" and not any(c in low for c in CUES) or kind == "access" and "AKIA" not in text:
            continue
        out += [(m.start(), k, m.end(), m[group]) for m in pattern.finditer(text) if len(m[group]) >= least]
    taken = _apart([(s, e) for s, _, e, _ in out])
    for k, (kind, (pattern, group, has)) in enumerate(MORE.items(), len(BASE)):
        if has not in text:
            continue
        more, i = [], 0
        for m in pattern.finditer(text):
            while i < len(taken) and taken[i][1] <= m.start():
                i += 1
            if any(s < m.end() for s, _ in taken[i : i + 1]):
                continue  # what a stronger kind has
            value = "".join(m[group].split()) if kind == "pem" else m[group]
            if kind != "random" or len(value) <= LONGEST and any(c.isupper() for c in value) and any(c.islower() for c in value) and looks_random(value):
                more.append((m.start(), k, m.end(), value))
        out += more
        taken = _apart(taken + [(s, e) for s, _, e, _ in more])
    return sorted(out)


def _apart(spans: list[tuple[int, int]]) -> list[tuple[int, int]]:
    """Sorted, overlapping ones as one."""
    out: list[tuple[int, int]] = []
    for s, e in sorted(spans):
        if out and s < out[-1][1]:
            out[-1] = (out[-1][0], max(e, out[-1][1]))
        else:
            out.append((s, e))
    return out


def _spans(text: str | None) -> list[dict]:
    return [
        {"start": s, "kind": k, "end": e, "value_sha256": hashlib.sha256(v.encode("utf-8", "surrogatepass")).hexdigest(), "looks_random": looks_random(v), "stand_in": any(w in v.lower() for w in STAND_INS)}
        for s, k, e, v in candidates(text or "")
    ]


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    kind = pa.list_(pa.struct([("start", pa.int64()), ("kind", pa.int32()), ("end", pa.int64()), ("value_sha256", pa.string()), ("looks_random", pa.bool_()), ("stand_in", pa.bool_())]))
    for batch in batches:
        at = batch.schema.get_field_index("secret_text")
        found = pa.array([_spans(t.as_py()) for t in batch.column(at)], kind)
        names = [n for n in batch.schema.names if n != "secret_text"]
        yield pa.RecordBatch.from_arrays([*(batch.column(batch.schema.get_field_index(n)) for n in names), found], names=[*names, "secret_found"])


def found(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """(kept: a struct of the columns in keep, secret_row, secret_repository, secret_owner, secret_found: candidates of the whole text), one row a row of docs, written."""
    kept = F.struct(*[F.col(f"`{c}`") for c in keep]).alias("kept")
    named = [kept, F.monotonically_increasing_id().alias("secret_row"), F.col(f"`{repository}`").cast("string").alias("secret_repository"), F.col(f"`{owner}`").cast("string").alias("secret_owner"), F.col(f"`{text}`").alias("secret_text")]
    narrow = docs.select(*named)
    schema = T.StructType([f for f in narrow.schema.fields if f.name != "secret_text"]).add("secret_found", T.ArrayType(_SPAN))
    return written(narrow.mapInArrow(trimmed(_scan), schema), "secrets")


def ownership(candidates_found: DataFrame) -> DataFrame:
    """(value_sha256, n_owners, n_repositories, n_rows, verdict) of each value: the corpus-wide counts.

    A null owner counts as one owner, a null repository as one of each owner; a repository belongs to its owner. Verdicts:
    `example` where OWNERS owners or more have the value, else `stand-in` for words as "changeme", `live` if it looks random, `weak` if not.
    """
    each = candidates_found.select("secret_owner", "secret_repository", F.explode("secret_found").alias("s")).select("secret_owner", "secret_repository", "s.value_sha256", "s.looks_random", "s.stand_in")
    value = ["value_sha256", "looks_random", "stand_in"]
    by_repository = each.groupBy(*value, "secret_owner", "secret_repository").agg(F.count("*").alias("n"))
    by_owner = by_repository.groupBy(*value, "secret_owner").agg(F.count("*").alias("repositories"), F.sum("n").alias("n"))
    counted = by_owner.groupBy(*value).agg(F.count("*").alias("n_owners"), F.sum("repositories").alias("n_repositories"), F.sum("n").alias("n_rows"))
    verdict = F.when(F.col("n_owners") >= OWNERS, "example").when(F.col("stand_in"), "stand-in").when(F.col("looks_random"), "live").otherwise("weak")
    return counted.select("value_sha256", "n_owners", "n_repositories", "n_rows", verdict.alias("verdict"))


def secrets(docs: DataFrame, *, keep: tuple[str, ...] = ("doc_id",), text: str = "text", repository: str = "doc_id", owner: str = "source") -> DataFrame:
    """One row a row of docs: the columns in keep and `secrets`, an array of (start, kind, end, value_sha256, n_owners, n_repositories, verdict) by start, then kind.

    start and end are code points, end exclusive; kind is a name of KINDS. All base matches are there; those of the further kinds are
    if they are live. A column in keep that is named secrets is replaced. Null and empty texts have none; repeated rows are scanned and counted each. No cap on spans or lengths.
    """
    scanned = found(docs, keep=keep, text=text, repository=repository, owner=owner)
    verdicts = ownership(scanned)
    each = scanned.filter(F.size("secret_found") > 0).select("secret_row", F.explode("secret_found").alias("s")).select("secret_row", "s.*")
    judged = each.join(verdicts, "value_sha256").filter((F.col("kind") < len(BASE)) | (F.col("verdict") == "live"))
    one = F.struct("start", "kind", "end", "value_sha256", "n_owners", "n_repositories", "verdict")
    spans = judged.groupBy("secret_row").agg(F.sort_array(F.collect_list(one)).alias("secrets"))
    names = F.array(*[F.lit(k) for k in KINDS])
    spans = spans.withColumn("secrets", F.transform("secrets", lambda s: s.withField("kind", F.get(names, s["kind"]))))
    quiet = scanned.filter(F.size("secret_found") == 0).withColumn("secrets", F.array().cast(spans.schema["secrets"].dataType)).select("kept", "secrets")
    told = scanned.filter(F.size("secret_found") > 0).join(spans, "secret_row", "left")
    return quiet.unionByName(told.select("kept", F.coalesce("secrets", F.array().cast(spans.schema["secrets"].dataType)).alias("secrets"))).select(*[F.col(f"kept.`{c}`") for c in keep if c != "secrets"], "secrets")


def _text(spans: Column) -> Column:
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op12(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = secrets(table(spark, sf_dir, "documents"))
    of = lambda *kinds: F.filter("secrets", lambda s: s["kind"].isin(*kinds))
    judged = lambda verdict: F.size(F.filter("secrets", lambda s: s["verdict"] == verdict)).cast("long")
    return out.select(
        "doc_id", *[F.size(of(k)).cast("long").alias(f"n_{k}") for k in BASE], F.sha2(_text(of(*BASE)), 256).alias("base_sha256"), _text(F.col("secrets")).alias("spans"),
        judged("live").alias("n_live"), judged("example").alias("n_example"),
    )
