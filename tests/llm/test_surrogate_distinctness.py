"""No two entities share a surrogate, whatever their forms."""

from pyspark.sql import functions as F
from tallyloom.llm import pii

SCHEMA = "doc_id long, text string"


def test_mail_of_two_forms_stays_apart(spark):
    # domains of which the permuted labels of one end like the kept ones of the other
    key = pii.KEY
    first = pii.canonical_surrogate("email", "anna@shop.com", key)
    other = next(v for a in "abcdefghijklmnopqrstuvwxyz" for b in "aeiouy" for c in "bcdfghjklmnpqrstvwxz" if pii.canonical_surrogate("email", v := f"anna@shop.{a}{b}{c}.example", key) == first)
    rows = [(1, "write to anna@shop.com today"), (2, f"or to {other} now"), (3, f"anna@shop.com and {other}")]
    out = {r["doc_id"]: r["text"] for r in pii.surrogate(spark.createDataFrame(rows, SCHEMA)).collect()}
    one, two = out[1].split()[2], out[2].split()[2]
    assert one != two and out[3].split()[0] == one and out[3].split()[2] == two


def test_surrogates_of_all_forms_are_distinct(spark):
    from tallyloom.llm.common import written

    mails = [f"{a}@{d}" for a in ("bo", "al", "xy") for d in ("ab.com", "ab.de", "ab.com.example", "ab.cd.example", "cd.ef.gh", "ab.example", "qa.ab.example", "ab.xa.example")]
    names = [f"Mr {n} here" for n in ("Bo", "Al", "Ed", "Jo", "Bob", "Abe", "Éva")]
    docs = spark.createDataFrame([(i, x) for i, x in enumerate(mails + names)], SCHEMA)
    found = written(pii._occurrences(docs.select(F.xxhash64("text"), "text"), pii.KEY), "t")
    moved = pii._moved(found, pii.KEY)
    every = found.select("kind", "value", "surrogate").distinct().join(moved, ["kind", "value"], "left").select("kind", "value", F.coalesce("s", "surrogate").alias("s")).collect()
    made = [(r["kind"], r["s"]) for r in every]
    assert len(set(made)) == len(made) >= 25 and not {(r["kind"], r["value"]) for r in every} & set(made)
