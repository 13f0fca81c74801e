"""Personal data: detection and keyed surrogates.

An entity's surrogate is a keyed permutation of its own kind's domain, so equal entities get equal surrogates in every
document (coreference) and different ones different surrogates (distinctness), without any table. Digits stay digits,
hexadecimal stays hexadecimal in its case, a letter stays a vowel or consonant of its script and case, separators stay
where they are; card numbers keep (in)validity of their check digit; the last letters of a name, which mark gender in
many languages, and its title stay. Mail goes to reserved example domains. Each word of a name is an entity: names are
found after titles and phrases of introduction, and their words then wherever else the document has them, so given names and
surnames that stand alone get the surrogates that they have in the full name.

Two collisions are left: a surrogate can equal another entity of the corpus, and entities of different forms (mail domains
of two and of three labels) can get one surrogate. A Spark job over the distinct entities (not over texts) finds both and moves them on by further rounds of the permutation, checked against originals and
surrogates alike, until none is left; where a form's domain is full, names, mail and phones grow by letters or digits. What it changes is joined to the documents that hold such an entity.
"""

from __future__ import annotations

import hashlib
import ipaddress
import re
import unicodedata
from bisect import bisect_left, insort
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, trimmed, written

KEY = b"tallyloom-surrogates-1"
ROUNDS = 6
#: Attempts at another surrogate of the same form where one meets an original; further ones are longer, by one letter or digit each.
RETRIES = 4
#: Attempts after which the job fails instead of keeping a surrogate that is taken.
MOST_ATTEMPTS = 60

# Title words that announce a name, by the gender they mark.
TITLES_M = ["Mr", "Herr", "Señor", "Sr", "Monsieur"]
TITLES_F = ["Mrs", "Ms", "Miss", "Frau", "Señora", "Sra", "Madame", "Mme"]
TITLES_ANY = ["Dr", "Prof"]
# Phrases after which people introduce themselves, beginnings of access keys, words before a secret.
INTRODUCTIONS = ["my name is", "My name is", "mein Name ist", "Mein Name ist", "ich heiße", "Ich heiße", "je m'appelle", "Je m'appelle", "me llamo", "Me llamo"]
KEY_STARTS = ["sk-", "pk_", "sk_", "rk_", "ghp_", "gho_", "ghs_", "github_pat_", "glpat-", "xoxb-", "xoxp-", "AKIA", "ASIA", "AIza", "eyJ"]
SECRET_WORDS = ["api_key", "apikey", "api-key", "access_key", "secret", "token", "password", "passwd", "pwd"]

_NAME = r"[^\W\d_]{2,}"
PATTERNS = {
    "email": re.compile(r"[\w.%+\-]+@(?:[A-Za-z0-9\-]+\.)+[A-Za-z]{2,}"),
    "secret": re.compile(r"(?<![0-9A-Za-z])(?:[0-9a-f]{32,128}|[0-9A-F]{32,128})(?![0-9A-Za-z])"),
    "key": re.compile(r"(?<![0-9A-Za-z])(?:" + "|".join(KEY_STARTS) + r")[0-9A-Za-z_\-.]{12,}[0-9A-Za-z]|(?<![A-Za-z])(?i:" + "|".join(SECRET_WORDS) + r")[\"']?\s{0,2}[=:]\s{0,2}[\"']?([^\s\"'<>,;]{8,})"),
    "ipv6": re.compile(r"(?<![\w:.])(?:[0-9A-Fa-f]{1,4}:){1,7}(?::?[0-9A-Fa-f]{1,4}){0,7}(?![\w:])"),
    "iban": re.compile(r"(?<![0-9A-Za-z])[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){3,7}(?: ?[A-Z0-9]{1,3})?(?![0-9A-Za-z])"),
    "ipv4": re.compile(r"(?<![\d.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\.?\d)"),
    "phone": re.compile(r"(?<![\w+])\+?\d{0,3}[ .\-]?\(?\d{3}\)[ .\-]?\d{3}[ .\-]\d{4}(?!\d)|(?<![\w+])(?:\+\d{1,3}[ .\-])?\d{3}[ .\-]\d{3}[ .\-]\d{4}(?![\d\-])|(?<![\w+])\+\d{1,3}(?:[ .\-]?\d{2,4}){2,5}(?!\d)"),
    "ssn": re.compile(r"(?<![\d\-])\d{3}-\d{2}-\d{4}(?![\d\-])"),
    "card": re.compile(r"(?<!\d)(?:\d{13,19}|\d{4}(?:[ \-]\d{4}){3}|\d{4}[ \-]\d{6}[ \-]\d{5})(?!\d)"),
    "name": re.compile(r"(?<!\w)(?:(?:" + "|".join(TITLES_M + TITLES_F + TITLES_ANY) + r")\.?|" + "|".join(INTRODUCTIONS) + r") (" + _NAME + r"(?:[ \-]" + _NAME + r"){0,2})"),
}
_DIGIT = re.compile(r"\d{3}")
_ANNOUNCED = re.compile(r"(?<!\w)(?:(?:" + "|".join(TITLES_M + TITLES_F + TITLES_ANY) + r")\.?|" + "|".join(INTRODUCTIONS) + r") \w")
_COLONS = re.compile(r"[0-9A-Fa-f]:[0-9A-Fa-f]{0,4}:")
_WORDS = re.compile(_NAME)


def _round(key: bytes, tweak: str, k: int, x: int) -> int:
    return int.from_bytes(hashlib.blake2b(f"{tweak}|{k}|{x}".encode(), key=key[:64], digest_size=16).digest(), "big")


def permute(value: int, u: int, v: int, key: bytes, tweak: str) -> int:
    """A keyed permutation of 0 .. u*v-1: a Feistel network over (value // v, value % v)."""
    a, b = divmod(value, v)
    for k in range(ROUNDS):
        if k % 2:
            b = (b + _round(key, tweak, k, a)) % v
        else:
            a = (a + _round(key, tweak, k, b)) % u
    return a * v + b


def _digits(text: str, key: bytes, tweak: str) -> str:
    n = len(text)
    if not n:
        return text
    u, v = 10 ** (n // 2), 10 ** (n - n // 2)
    return str(permute(int(text), u, v, key, f"{tweak}|{n}")).zfill(n)


def _refill(shape: str, symbols: str, is_symbol) -> str:
    """The symbols of shape replaced in order."""
    it = iter(symbols)
    return "".join(next(it) if is_symbol(c) else c for c in shape)


# Letters by script, vowels and consonants; a letter is replaced within its own list.
LETTERS = [
    "aeiouy", "bcdfghjklmnpqrstvwxz", "àâäáãåæèéêëìíîïòóôöõøœùúûüýÿ", "çñßšžčřđł",
    "αεηιουω", "βγδζθκλμνξπρσςτφχψ", "аеёиоуыэюя", "бвгджзйклмнпрстфхцчшщьъ",
]
_CLASS = {c: (k, i) for k, cs in enumerate(LETTERS) for i, c in enumerate(cs)} | {str(i): (-1, i) for i in range(10)}
_SET = {-1: "0123456789"} | dict(enumerate(LETTERS))


@lru_cache(4096)
def _others(low: str) -> str:
    """For a letter outside LETTERS: those of its script, category and block of 256."""
    block, script = ord(low) & ~255, unicodedata.name(low, "").split(" ")[0]
    near = (chr(i) for i in range(block, block + 256))
    return "".join(x for x in near if x.isalpha() and x.lower() == x and x not in _CLASS and unicodedata.category(x) == unicodedata.category(low) and unicodedata.name(x, "").split(" ")[0] == script)


def _class(c: str) -> tuple[int, int, str] | None:
    """(number of the class, place in it, its members) of a letter or digit."""
    low = c.lower()
    if low in _CLASS:
        k, i = _CLASS[low]
        return k, i, _SET[k]
    if len(low) != 1 or not low.isalpha() or len(own := _others(low)) < 2 or low not in own:
        return None
    return 1000 + ord(own[0]), own.index(low), own


def _letters(text: str, key: bytes, tweak: str, keep_last: int = 0) -> str:
    """Letters and digits permuted within their class, script and case; other characters and the last keep_last letters stay."""
    at = [(i, *found) for i, c in enumerate(text) if (found := _class(c))]
    at = at[: len(at) - keep_last] if len(at) > keep_last + 1 else at
    if not at:
        return text
    kinds = [k for _, k, _, _ in at]
    half = len(at) // 2
    sizes = [len(own) for *_, own in at]
    u = v = 1
    for s in sizes[:half]:
        u *= s
    for s in sizes[half:]:
        v *= s
    value = 0
    for (_, _, d, _), s in zip(at, sizes, strict=True):
        value = value * s + d
    stays = "".join(c for i, c in enumerate(text) if i > at[-1][0])
    shape = "".join(f"{k:x}." for k in kinds) + stays.lower()
    value = permute(value, u, v, key, f"{tweak}|{shape}")
    out = list(text)
    for (i, _, _, own), s in zip(reversed(at), reversed(sizes), strict=True):
        value, d = divmod(value, s)
        c = own[d]
        out[i] = c.upper() if text[i].isupper() and len(c.upper()) == 1 else c
    return "".join(out)


def _check_digit(body: str) -> int:
    total = 0
    for i, c in enumerate(reversed(body)):
        d = int(c) * (2 if i % 2 == 0 else 1)
        total += d - 9 * (d > 9)
    return -total % 10


def _email(value: str, key: bytes, tweak: str) -> str:
    local, _, domain = value.rpartition("@")
    labels = domain.split(".")
    keep = 2 if len(labels) > 2 and labels[-2] == "example" else 0
    head, tail = (labels[:-keep], labels[-keep:]) if keep else (labels[:-1], [labels[-1], "example"] if labels[-1] != "example" else ["example"])
    local = _letters(local, key, f"{tweak}|local")
    return f"{local}@{'.'.join([_letters(x, key, f'{tweak}|domain') for x in head] + tail)}"


def canonical(kind: str, value: str) -> str:
    """Spellings of one entity: mail, secrets and names ignore case, numbers their separators."""
    if kind in ("phone", "card", "ssn"):
        return re.sub(r"\D", "", value)
    if kind == "iban":
        return value.replace(" ", "")
    if kind == "ipv6":
        return ipaddress.ip_address(value).exploded
    return value if kind in ("ipv4", "key") else value.lower()


def _wider(kind: str, value: str, made: str, key: bytes, more: int) -> str:
    """A surrogate with `more` further keyed letters (digits of a phone), before a name's last letter or at the end of a mailbox."""
    head, tail = (made[:-1], made[-1:]) if kind == "name" else (made[: made.rindex("@")], made[made.rindex("@") :]) if kind == "email" else (made, "")
    word = head.split(" ")[-1] + (tail if kind == "name" else "")
    classes = [_SET[-1]] if kind == "phone" else [found[2] for c in word if c.isalpha() and (found := _class(c))] or [LETTERS[1]]
    for j in range(more):
        own = classes[j % len(classes)]
        head += own[_round(key, f"{kind}|wider|{more}|{value}", j, 0) % len(own)]
    return head + tail


@lru_cache(20_000)
def canonical_surrogate(kind: str, value: str, key: bytes = KEY, attempt: int = 0) -> str:
    """The surrogate of a canonical value; one-to-one for each attempt up to RETRIES among values of a kind and form. Between forms, _moved() sees to it."""
    made = _permuted(kind, value, key, f"{kind}|{attempt}")
    return _wider(kind, value, made, key, attempt - RETRIES) if attempt > RETRIES and kind in ("name", "email", "phone") else made


def _permuted(kind: str, value: str, key: bytes, tweak: str) -> str:
    if kind == "email":
        return _email(value, key, tweak)
    if kind == "secret":
        n = len(value)
        return f"{permute(int(value, 16), 16 ** (n // 2), 16 ** (n - n // 2), key, f'{tweak}|{n}'):0{n}x}"
    if kind == "iban":
        return value[:2] + _digits(value[2:4], key, f"{tweak}|c{value[4:]}") + _letters(value[4:].lower(), key, tweak).upper()
    if kind == "ipv4":
        a, b, c, d = map(int, value.split("."))
        x = permute((a << 24) | (b << 16) | (c << 8) | d, 1 << 16, 1 << 16, key, tweak)
        return ".".join(str(x >> s & 255) for s in (24, 16, 8, 0))
    if kind == "ipv6":
        return ipaddress.IPv6Address(permute(int(ipaddress.ip_address(value)), 1 << 64, 1 << 64, key, tweak)).exploded
    if kind == "key":
        start = next((x for x in KEY_STARTS if value.startswith(x)), "")
        return start + _letters(value[len(start) :], key, f"{tweak}|{start}")
    if kind == "phone":
        # a country code and the digits after it: the national number is permuted
        head = max(0, len(value) - 10)
        return value[:head] + _digits(value[head:], key, f"{tweak}|{value[:head]}")
    if kind == "card":
        body, last = value[:-1], int(value[-1])
        off = (last - _check_digit(body)) % 10
        body = body[:1] + _digits(body[1:], key, f"{tweak}|{off}|{body[:1]}")
        return body + str((_check_digit(body) + off) % 10)
    if kind == "ssn":
        return _digits(value, key, tweak)
    return _letters(value, key, f"{tweak}|word", keep_last=1)


def render(kind: str, original: str, value: str) -> str:
    """A canonical surrogate in the form of the text that it replaces."""
    if kind in ("phone", "card", "ssn"):
        return _refill(original, value, str.isdigit) + value[sum(map(str.isdigit, original)) :]
    if kind == "iban":
        return _refill(original, value, str.isalnum)
    if kind in ("secret", "ipv6"):
        return value.upper() if original.upper() == original else value
    if kind == "name":
        return "".join(c.upper() if original[min(i, len(original) - 1)].isupper() else c for i, c in enumerate(value))
    return value.upper() if kind == "email" and original.upper() == original else value


def entities(text: str) -> list[tuple[int, int, str]]:
    """(start, end, kind) of the entities of a text, in order, without overlaps: the earlier kind of PATTERNS wins."""
    kinds = []
    if "@" in text:
        kinds.append("email")
    digits = _DIGIT.search(text)
    if digits:
        kinds.append("secret")
    low = text.lower()
    if any(w in low for w in SECRET_WORDS) or any(w in text for w in KEY_STARTS):
        kinds.append("key")
    if ("::" in text or text.count(":") > 6) and _COLONS.search(text):
        kinds.append("ipv6")
    if digits:
        kinds += ["iban", "ipv4", "phone", "ssn", "card"]
    elif re.search(r"\d\.\d", text):
        kinds.append("ipv4")
    found: list[tuple[int, int, str]] = []

    def add(s: int, e: int, kind: str) -> None:
        at = bisect_left(found, (s,))
        if (at == 0 or found[at - 1][1] <= s) and (at == len(found) or e <= found[at][0]):
            insort(found, (s, e, kind))

    for kind in kinds:
        for m in PATTERNS[kind].finditer(text):
            if kind == "ipv6" and not _is_address(m[0]):
                continue
            add(*m.span(1 if kind == "key" and m[1] else 0), kind)
    if _ANNOUNCED.search(text):
        names: dict[str, None] = {}
        for m in PATTERNS["name"].finditer(text):
            for w in _WORDS.findall(m[1]):
                if w[0].title() != w[0] or w in TITLES_M + TITLES_F + TITLES_ANY:  # the name has ended
                    break
                names[w] = None
        if names:
            again = re.compile(r"(?<!\w)(?:" + "|".join(map(re.escape, names)) + r")(?!\w)")
            for m in again.finditer(text):
                add(*m.span(), "name")
    return found


def _is_address(text: str) -> bool:
    try:
        return len(text) > 4 and ipaddress.ip_address(text).version == 6
    except ValueError:
        return False


def replace(text: str, key: bytes = KEY, moved: dict[str, str] | None = None) -> tuple[str, list[str]]:
    """The text with surrogates, and the kinds replaced, in order. moved: other surrogates, by kind:canonical value."""
    found = entities(text)
    if not found:
        return text, []
    out, at = [], 0
    for s, e, kind in found:
        value = canonical(kind, text[s:e])
        new = (moved or {}).get(f"{kind}:{value}") or canonical_surrogate(kind, value, key)
        out += [text[at:s], render(kind, text[s:e], new)]
        at = e
    return "".join(out) + text[at:], [k for _, _, k in found]


def _occurrences(docs: DataFrame, key: bytes) -> DataFrame:
    """(t, text), t the text's hash -> distinct (t, kind, value, surrogate) within each document."""
    names = ["t", "kind", "value", "surrogate"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            rows = [
                (d, k, v, canonical_surrogate(k, v, key))
                for d, t in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)
                if t
                for k, v in dict.fromkeys((k, canonical(k, t[s:e])) for s, e, k in entities(t))
            ]
            columns = list(zip(*rows, strict=True)) or [()] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, kind) for c, kind in zip(columns, (pa.int64(), pa.string(), pa.string(), pa.string()), strict=True)], names)

    return docs.mapInArrow(trimmed(run), "t long, kind string, value string, surrogate string")


def _attempt(key: bytes, attempt: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, values = (batch.column(i).to_pylist() for i in (0, 1))
            new = [canonical_surrogate(k, v, key, attempt) for k, v in zip(kinds, values, strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(new, pa.string())], ["kind", "value", "s"])

    return run


def _moved(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, value, surrogate) of entities whose first surrogate is an original of the corpus, stays itself, or is that of another entity too: of those the least keeps it."""
    known = written(found.select("kind", "value", "surrogate").distinct(), "entities")
    taken = known.select("kind", F.col("value").alias("s")).unionByName(known.select("kind", F.col("surrogate").alias("s"))).distinct()
    met = known.join(known.select("kind", F.col("value").alias("surrogate")), ["kind", "surrogate"], "left_semi").select("kind", "value")
    keepers = known.groupBy("kind", "surrogate").agg(F.min("value").alias("keeper"), F.count(F.lit(1)).alias("n")).filter("n > 1")
    shared = known.join(keepers, ["kind", "surrogate"]).filter("value <> keeper").select("kind", "value")
    open_ = met.unionByName(shared).distinct()
    done = None
    for attempt in range(1, MOST_ATTEMPTS + 1):
        tried = written(open_.mapInArrow(_attempt(key, attempt), "kind string, value string, s string"), "surrogates")
        if tried.isEmpty():
            break
        used = taken if done is None else taken.unionByName(done.select("kind", "s"))
        good = tried.join(used, ["kind", "s"], "left_anti").groupBy("kind", "s").agg(F.min("value").alias("value"))
        good = written(good.select("kind", "value", "s"), "moved")
        done = good if done is None else done.unionByName(good)
        open_ = tried.join(good, ["kind", "value"], "left_anti").select("kind", "value")
    else:
        if not open_.isEmpty():
            raise RuntimeError("surrogates still meet other entities")
    spark = known.sparkSession
    return done if done is not None else spark.createDataFrame([], "kind string, value string, s string")


def surrogate(docs: DataFrame, *, text: str = "text", key: bytes = KEY, kinds: str | None = None) -> DataFrame:
    """docs with surrogates in `text`; kinds: name of an added column, the array of kinds replaced in order.

    A null text stays null, with no kinds. Repeated rows and rows without a doc_id are treated alike: what an entity
    becomes depends on the entity alone. All other columns stay as they are.
    """
    # what an entity becomes depends on it alone, so texts meet their entities by the text's hash: one that two texts share only adds entries
    found = written(_occurrences(docs.select(F.xxhash64(text), F.col(text)), key), "occurrences")
    moved = _moved(found, key)
    kept, extra = [c for c in docs.columns if c != kinds], "pii_moved"
    while extra in docs.columns:
        extra += "_"
    moves = F.map_from_entries(F.collect_set(F.struct(F.concat_ws(":", "kind", "value"), "s"))).alias(extra)
    by_text = found.join(moved, ["kind", "value"]).groupBy(F.col("t").alias(extra + "_t")).agg(moves)
    if moved.isEmpty():
        joined = docs.withColumn(extra, F.lit(None).cast("map<string,string>"))
    else:
        joined = docs.join(by_text, F.xxhash64(docs[text]) == by_text[extra + "_t"], "left")
    out = joined.select(*[F.col(f"`{c}`") for c in kept], extra)
    schema = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in docs.select(*[F.col(f"`{c}`") for c in kept]).schema] + ([f"`{kinds}` array<string>"] if kinds else []))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at = kept.index(text)
        for batch in (b.slice(k, 512) for b in batches for k in range(0, b.num_rows, 512)):
            texts, maps = batch.column(at).to_pylist(), batch.column(len(kept)).to_pylist()
            done = [(None, []) if t is None else replace(t, key, dict(m) if m else None) for t, m in zip(texts, maps, strict=True)]
            columns = [pa.array([d[0] for d in done], pa.string()) if i == at else batch.column(i) for i in range(len(kept))]
            yield pa.RecordBatch.from_arrays(columns + ([pa.array([d[1] for d in done], pa.list_(pa.string()))] if kinds else []), kept + ([kinds] if kinds else []))

    return out.mapInArrow(trimmed(run), schema)


def op10(spark: SparkSession, sf_dir: str) -> DataFrame:
    return surrogate(table(spark, sf_dir, "documents").select("doc_id", "text"), kinds="kinds")
