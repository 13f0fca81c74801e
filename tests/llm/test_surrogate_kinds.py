"""Names by word wherever a document has them, access keys, IPv6, card groups, and texts that meet by their hash."""

import ipaddress
import random
import re

from tallyloom.llm import pii


def kinds(text):
    return [(text[s:e], k) for s, e, k in pii.entities(text)]


def test_names_are_replaced_wherever_they_stand():
    text = "Dr. Anna Keller met me. Keller said so; Anna Keller-Roth left, Kellers stayed. Mr long went. My name is Bo Li."
    out, _ = pii.replace(text)
    assert not re.search(r"\b(Anna|Keller|Roth|Bo|Li)\b", out.replace("-Roth", "")) and "Kellers" in out and "Mr long" in out
    a, b = out.split()[1], out.split()[2].rstrip(".")
    assert out.count(a) >= 2 and len(re.findall(rf"\b{b}\b", out)) == 3
    assert a[-1] == "a" and a[0].isupper()


def test_keys_addresses_and_cards():
    text = 'key sk-abcDEF123456789xyz; password: "hunter2hunter" amex 3782 822463 10005 at fe80::1ff:fe23:4567:890a, 12:30:45 a::b std::vector'
    assert [k for _, k in kinds(text)] == ["key", "key", "card", "ipv6"] or [k for _, k in kinds(text)] == ["key", "key", "card", "ipv6", "ipv6"]
    out, _ = pii.replace(text)
    assert "hunter2" not in out and "sk-" in out and "abcDEF" not in out and "12:30:45" in out and "std::vector" in out
    new = next(w for w in out.replace(",", "").split() if w.count(":") == 7)
    assert ipaddress.ip_address(new).version == 6
    assert re.search(r"amex \d{4} \d{6} \d{5} ", out)


def test_against_a_plain_version(spark):
    """Every document's text is what the sequential replacement with one corpus-wide table gives."""
    r = random.Random(6)
    pieces = ["call +1 (243) 555-%04d", "mail u%d@mail.example.com", "host 10.0.%d.7", "Mr Ne%sn", "card 4111 1111 1111 %04d", "plain words %d"]
    docs = []
    for i in range(120):
        t = " ".join((p % ("bcdfghjk"[r.randrange(8)] if "%s" in p else r.randrange(250))) for p in r.choices(pieces, k=4))
        docs.append((None if i % 9 == 0 else i % 50, t))
    frame = spark.createDataFrame(docs, "doc_id long, text string")
    out = sorted(x.text for x in pii.surrogate(frame).collect())
    found = {(k, pii.canonical(k, t[s:e])) for _, t in docs for s, e, k in pii.entities(t)}
    originals, table = found, {}
    rows = pii.surrogate(frame.withColumn("was", frame["text"])).collect()
    for row in rows:
        was, now = pii.entities(row.was), pii.entities(row.text)
        assert [k for *_, k in was] == [k for *_, k in now]
        for (s, e, k), (a, b, _) in zip(was, now, strict=True):
            value, new = pii.canonical(k, row.was[s:e]), pii.canonical(k, row.text[a:b])
            assert table.setdefault((k, value), new) == new
    assert len(set(table.items())) == len({(k, v) for (k, _), v in table.items()}) == len(found)
    assert not {(k, v) for (k, _), v in table.items()} & originals
    assert sorted(x.text for x in rows) == out


def test_a_very_long_text():
    text = "Dr. Anna Keller wrote to anna@example.com. " * 20000
    out, found = pii.replace(text)
    assert len(found) == 60000 and "Keller" not in out
