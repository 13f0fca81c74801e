"""Surrogates stay distinct where a form's domain is full, and change names of any script."""

from tallyloom.llm import pii

FULL = [a + b + "n" for a in "BCDFGHJKLMNPQRSTVWXZ" for b in "aeiouy"]
SCRIPTS = ["Mr محمود", "Herr שלום", "Dr 李明", "Prof ირაკლი", "Frau Łőrincz", "Mme 김민준", "Mr कमल"]


def test_full_domain_of_names(spark):
    docs = spark.createDataFrame([(i, f"Well, Mr {n}, so") for i, n in enumerate(FULL)], "doc_id long, text string")
    out = [r.text.split()[2].rstrip(",") for r in pii.surrogate(docs).collect()]
    assert len(set(out)) == len(FULL) and not set(out) & set(FULL)
    assert all(n[0].isupper() and n[1:].islower() and n[-1] == "n" for n in out)


def test_names_of_any_script_are_changed(spark):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(SCRIPTS)] + [(90, "Mr İsmail")], "doc_id long, text string")
    out = {r.doc_id: r.text for r in pii.surrogate(docs).collect()}
    names = [out[i].split()[1] for i in range(len(SCRIPTS))]
    assert all(a != t.split()[1] and len(a) == len(t.split()[1]) for a, t in zip(names, SCRIPTS, strict=True))
    assert len(set(names)) == len(names) and "smail" not in out[90]
    assert pii._others(names[0][0]) == pii._others("م") and pii._others(names[2][0]) == pii._others("李")


def test_longer_surrogates_keep_what_they_add():
    made = pii.canonical_surrogate("phone", "12345", attempt=pii.RETRIES + 2)
    assert len(made) == 7 and pii.render("phone", "+1 23 45", made).endswith(made[-2:])
    mail = pii.canonical_surrogate("email", "ab@mail.example.com", attempt=pii.RETRIES + 3)
    assert len(mail.split("@")[0]) == 5 and mail.endswith(".example.com")
