from __future__ import annotations

import hashlib
import random
import re

import brute
from pyspark.sql import functions as F

from clearledger.llm import pii, queries


def test_query_equals_brute_force(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    wanted = {r["doc_id"]: brute.personal(r["text"]) for r in docs.collect()}
    rows = queries.QUERIES["op10_pii"](spark, folder).collect()
    assert len(rows) == len(wanted)
    for r in rows:
        spans = wanted[r["doc_id"]]
        assert r["base_sha256"] == brute.sha(brute.listed(spans))
        assert [r[f"n_{k}"] for k in brute.KINDS] == [sum(s[1] == i for s in spans) for i in range(4)]
        listed = [x for x in r["spans"].split(",") if x]
        assert set(brute.listed(spans).split(",")) - {""} <= set(listed)
        assert listed == sorted(listed, key=lambda x: (int(x.split(":")[1]), brute.KINDS.index(x.split(":")[0])))


TEXTS = [
    "a@b.c@d.ef x@y.z_q@r.st ..@-.- a@b a@.c @x.y %+@q.w.", "1.2.3.4.5.6.7.8 256.1.1.1 0001.02.3.255 1.2.3", "é中😀 1.2.3.4😀a@b.cd",
    "4111111111111111 4111-1111-1111-1111 4111  1111 1111 1111 4111 1111 1111 1112 41111111111111111111",
    "+1 (017) 555-7713 +1 555 +12345678901234567 ++123456789012 +1234567890.", "1 " * 500, "9" * 3000, "@" * 2000, "a" * 5000 + "@",
    "+1 2 3 4 5 6 7 8 9 0 1 2 3 4 5 6 7 +1-2345678901x", "1.1.1." * 300,
] + ["a.b@c.de 10.0.0.%d " % (i % 300) * (i + 1) for i in range(5)]


def test_fixed_patterns_equal_the_plain_ones(spark, edges):
    docs = spark.createDataFrame([(i, t) for i, t in enumerate(TEXTS)], "doc_id long, text string")
    for rows in (docs, edges):
        for r in pii.with_spans(rows, keep=("doc_id", "text")).collect():
            assert [tuple(s) for s in r["base"]] == brute.personal(r["text"]), r["text"]


def test_positions_of_many_matches(spark):
    text = " ".join(f"é{i} u{i}@h{i}.org" for i in range(1500))
    [row] = pii.with_spans(spark.createDataFrame([(text,)], "text string"), keep=("text",)).collect()
    assert [tuple(s) for s in row["base"]] == brute.personal(text)


def customers(spark):
    """Known numbers behind one phrase, then numbers of another make behind the same phrase."""
    known = ["4111111111111111", "5500005555555559", "340000000000009", "30000000000004", "6011000000000004"]
    rows = [(i, f"please debit account number {n} today") for i, n in enumerate(known)]
    rows += [(50, "please debit account number 55-00-81-77-20 today"), (51, "the train 55-00-81-77-21 is late")]
    rows += [(60 + i, f"chapter {i} has 1234567{i} letters") for i in range(5)]
    return spark.createDataFrame(rows, "doc_id long, text string")


def test_contexts_of_known_identifiers_find_unknown_ones(spark):
    rows = {r["doc_id"]: r for r in pii.with_spans(customers(spark), keep=("doc_id", "text")).collect()}
    more = {k: [tuple(s) for s in r["spans"] if s not in r["base"]] for k, r in rows.items()}
    assert more.pop(50) == [(28, 2, 42)]
    assert not any(more.values())


def test_masking(spark, edges, no_documents):
    got = pii.masking(edges)
    assert got.columns == edges.columns and got.dtypes == edges.dtypes
    texts = {r["doc_id"]: r for r in got.where("doc_id IS NOT NULL").collect()}
    assert texts[10]["text"] == "mail [EMAIL] and [IP], card [CARD], call [PHONE] now"
    assert texts[10]["n_chars"] == len(texts[10]["text"])
    assert texts[3]["text"] is None and texts[4]["text"] == ""
    assert got.count() == edges.count()
    clean = edges.where("doc_id IN (1, 2, 7, 8)")
    assert pii.masking(clean).exceptAll(clean).count() == 0
    assert pii.masking(no_documents).count() == 0
    assert pii.with_spans(no_documents).count() == 0


def test_overlapping_spans_give_one_mark(spark):
    row = spark.createDataFrame([("a +4111111111111111 b",)], "text string")
    [got] = pii.masking(row, size=None).collect()
    assert got["text"].count("[") == 1 and got["text"].startswith("a ") and got["text"].endswith(" b")


def card(n):
    body = f"411111{n:09d}"
    return next(body + str(c) for c in range(10) if brute.luhn(body + str(c)))


def test_identifiers_found_find_others_in_their_turn(spark):
    """Known cards stand behind one phrase, found numbers behind it and a second, the last behind the second and a third."""
    first, second, third = "please debit account number {} today", "refund goes to folder {} soon", "see also drawer {} below"
    one, two, three = ([f"{a}-00-81-77-{b:02d}" for b in range(n)] for a, n in ((55, 25), (66, 5), (77, 1)))
    texts = [first.format(card(n)) for n in range(110)] + [first.format(x) for x in one]
    texts += [second.format(x) for x in one + two] + [third.format(x) for x in two + three]
    texts += ["the train 88-00-81-77-10 is late"]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    rows = {r["text"]: r for r in pii.with_spans(docs, keep=("text",)).collect()}
    for text, row in rows.items():
        begin = text.find("-00-81") - 2
        wanted = begin > 0 and not text.startswith("the train")
        assert [tuple(s) for s in row["spans"] if s not in row["base"]] == [(begin, 2, begin + 14)] * wanted, text


def plain_candidates(text):
    """Candidates with their contexts, from the whole text on both sides."""
    blank, word = r"[\x20\x09-\x0D]", r"[^\x20\x09-\x0D]"
    one = r"[^\x20\x09-\x0D@]"
    found = re.compile(
        rf"(?<![^\x20\x09-\x0D@]){one}+@{one}+|(?<![A-Za-z0-9/.-])(?=[A-Za-z0-9/.-]*[A-Za-z])(?=[A-Za-z0-9/.-]*[0-9])"
        r"[A-Za-z0-9]+(?:[/.-]+[A-Za-z0-9]+)*(?![A-Za-z0-9])|(?<![A-Za-z0-9])[+(]{0,2}[0-9][0-9().\x20/-]*[0-9](?![A-Za-z0-9])"
    )

    def plain(part):
        return re.sub("[0-9]+", "0", part.strip(" \t\n\r").lower())

    def named(name):
        return hashlib.sha256(name.encode()).hexdigest() if len(name) > pii.NAMED else name

    out = []
    for m in found.finditer(text):
        before, last = (
            re.search(rf"{p}$", text[: m.start()])[0] for p in (rf"(?:(?:{word}+{blank}+)?{word}+)?{blank}*", rf"{word}*{blank}*")
        )
        after = re.match(rf"{blank}*{word}*", text[m.end() :])[0]
        contexts = ["l " + plain(before), "b " + plain(last) + " _ " + plain(after)]
        contexts = [named(c) for c in contexts if not (c.startswith(("l ", "b  _")) and len(c) <= 4)]
        out.append((m.start(), m.end(), named(re.sub("[^a-z0-9@]", "", m[0].lower())), contexts))
    return out


def test_candidates_equal_plain_ones(spark):
    pick = random.Random(8)
    words = ["pay", "Due", "é", "😀", "12", "3", "AB-12", "(55", "x@y", "7/8x", "w" * 300, "1" * 300, "ab.c", "no:"]
    texts = ["".join(pick.choice(words) + pick.choice([" ", "  ", "\n"]) for _ in range(pick.randint(0, 12))) for _ in range(300)]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    for row in docs.select("text", pii.candidates("text").alias("c")).collect():
        got = [(c["start"], c["end"], c["instance"], c["contexts"]) for c in row["c"]]
        assert got == plain_candidates(row["text"]), row["text"]


def test_long_runs_are_read_once(spark):
    texts = ["a-" * 100_000, "1-" * 100_000, "a1-" * 100_000, "w" * 200_000 + " 12", "x 12 " * 40_000]
    docs = spark.createDataFrame(list(enumerate(texts)), "id int, text string")
    sizes = docs.select("id", F.size(pii.candidates("text")).alias("n")).collect()
    assert {r["id"]: r["n"] for r in sizes} == {0: 0, 1: 1, 2: 1, 3: 1, 4: 40_000}


def test_identifiers_of_any_length_are_found(spark):
    """Behind the phrase of known cards stand numbers and codes of 3 to 300 characters, after a word of any length."""
    for word in ("number", "n" * 120):
        rows = [f"please debit account {word} {card(n)} today" for n in range(60)]
        codes = ["571", "A-7", "ZX-40-B", "5" * 60, "-".join(["b7c"] * 75)]
        docs = [*rows, *(f"please debit account {word} {c} today" for c in codes), "the train 572 is late, A-8 too"]
        df = spark.createDataFrame([(t,) for t in docs], "text string")
        got = {r["text"]: [r["text"][s["start"] : s["end"]] for s in r["spans"] if s not in r["base"]]
               for r in pii.with_spans(df, keep=("text",)).collect()}
        assert [got[f"please debit account {word} {c} today"] for c in codes] == [[c] for c in codes]
        assert got["the train 572 is late, A-8 too"] == []
