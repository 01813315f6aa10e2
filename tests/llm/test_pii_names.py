"""Names, numbers and secrets in every spelling: nothing stays, and one person, number or secret is one other."""

import re

import numpy as np

from melodex.llm import pii


def replaced(spark, texts):
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    return [r.text for r in pii.pseudonymise(df, "k").orderBy("doc_id").collect()]


def test_titles_in_runs_capitals_and_over_lines(spark):
    texts = ["Herr Dr. Müller kam", "MR. SMITH paid", "Mr.\nJohn Smith", "Dr. John Smith", "Frau Prof. Dr. Weiß-Lang, dr. house", "Mr.  Ann\tLee", "Herr Dr. und Frau", "Mr. Don Smith", "Mrs. Smith\nThe end", "Mr. John\nSmith"]
    got = replaced(spark, texts)
    for t, leak in zip(got, ["Müller", "SMITH", "John|Smith", "John|Smith", "Weiß|Lang", "Ann|Lee", "nothing", "Don|Smith", "Smith", "John|Smith"]):
        assert not re.search(leak, t), t
    assert re.fullmatch(r"Herr Dr\. [A-Z]\w+ kam", got[0]) and re.fullmatch(r"MR\. [A-Z]+ paid", got[1])
    assert re.fullmatch(r"Mr\.\n[A-Z]\w+ [A-Z]\w+", got[2]) and re.fullmatch(r"Dr\. [A-Z]\w+ [A-Z]\w+", got[3])
    assert re.fullmatch(r"Frau Prof\. Dr\. [A-Z]\w+-[A-Z]\w+, dr\. house", got[4]) and re.fullmatch(r"Mr\.  [A-Z]\w+\t[A-Z]\w+", got[5])
    assert got[6] == texts[6] and re.fullmatch(r"Mr\. [A-Z]\w+ [A-Z]\w+", got[7])
    assert re.fullmatch(r"Mrs\. [A-Z]\w+\nThe end", got[8]) and re.fullmatch(r"Mr\. [A-Z]\w+\n[A-Z]\w+", got[9])


def test_one_person_in_a_text(spark):
    """A cue, a neutral title and a bare full name are the person whose title tells the gender; two genders stay two."""
    texts = ["Mr. John Smith. Contact: John Smith, Dr. Smith, John  Smith and MR. JOHN SMITH", "Name: Jane Doe met Ms. Doe", "Mr. Roe and Mrs. Roe, Dear Roe", "Name: Jane Doe met Mr. Bill Doe", "Mr. O'Neil and Mr. O’Neil and MR. O'NEIL; Mr. Smith's"]
    got = replaced(spark, texts)
    m = re.fullmatch(r"Mr\. (\w+) (\w+)\. Contact: (\w+) (\w+), Dr\. (\w+), (\w+)  (\w+) and MR\. (\w+) (\w+)", got[0]).groups()
    assert m[0] == m[2] == m[5] and m[1] == m[3] == m[4] == m[6] and (m[7], m[8]) == (m[0].upper(), m[1].upper()) and re.search("(ton|rik|mus|do)$", m[1])
    m = re.fullmatch(r"Name: (\w+) (\w+) met Ms\. (\w+)", got[1]).groups()
    assert m[1] == m[2] and re.search("(lia|na|ra|sa)$", m[1])
    m = re.fullmatch(r"Mr\. (\w+) and Mrs\. (\w+), Dear (\w+)", got[2]).groups()
    assert len(set(m)) == 3
    m = re.fullmatch(r"Name: (\w+) (\w+) met Mr\. (\w+) (\w+)", got[3]).groups()
    assert m[1] != m[3]
    m = re.fullmatch(r"Mr\. ([A-Z]'[A-Z][a-z]+) and Mr\. ([A-Z]’[A-Z][a-z]+) and MR\. ([A-Z]'[A-Z]+); Mr\. ([A-Z][a-z]+)'s", got[4]).groups()
    assert m[0] == m[1].replace("’", "'") and m[2] == m[0].upper() and "Neil" not in m[0]


def test_numbers_and_secrets_in_every_spelling(spark):
    texts = ["phone 9885552485 or (988) 555-2485 or 988-555-2485", "pwd: hunter2hunter2, passphrase=correct-horse PWD=abcdef99", "Authorization: Bearer abc.DEF-123456== and authorization: basic dXNlcjpwYXNz", "id 1234567890, 98855524851, v9885552485 and 988555248", "Authorization: required; bearer of news"]
    got = replaced(spark, texts)
    a, *b = re.fullmatch(r"phone (\d{10}) or \((\d{3})\) (\d{3})-(\d{4}) or (\d{3})-(\d{3})-(\d{4})", got[0]).groups()
    assert a == "".join(b[:3]) == "".join(b[3:]) != "9885552485"
    assert not re.search("hunter|correct|horse|abcdef99", got[1]) and re.fullmatch(r"pwd: \w{14}, passphrase=\w{7}-\w{5} PWD=\w{8}", got[1])
    assert re.fullmatch(r"Authorization: Bearer \w{3}\.\w{3}-\w{6}== and authorization: basic \w{12}", got[2]) and not re.search("DEF|dXNl", got[2])
    assert got[3:] == texts[3:]


def test_persons_by_brute_force(spark):
    """Generated persons in all spellings: within a text one mapping of surnames and given names for each person; over the
    corpus different surnames, whatever their genders, get different ones, none of which is in the data."""
    rng = np.random.default_rng(3)
    word = lambda: "".join("abcdlmnorst"[k] for k in rng.integers(0, 11, rng.integers(2, 4))).title()
    people = sorted({(word(), word(), "mf"[int(rng.integers(0, 2))]) for _ in range(250)})
    people = [p for p in people if not {"Mr", "Mrs", "Ms", "Dr", "Don", "Sr"} & set(p)]
    texts = []
    for given, surname, g in people:
        t = "Mr" if g == "m" else "Mrs"
        texts.append(f"{t}. {given} {surname}|{t.upper()}. {surname.upper()}|Dr. {given} {surname}|Name: {given} {surname}|{given} {surname}|{t} {surname}")
    seen = {}
    for (given, surname, g), text in zip(people, replaced(spark, texts)):
        parts = [re.sub(r"^(?:(?:MRS?|Mrs?|Dr)\.? |Name: )", "", x).lower().split() for x in text.split("|")]
        assert len({p[-1] for p in parts}) == 1 and len({p[0] for p in parts if len(p) > 1}) == 1, text
        seen.setdefault((surname.lower(), g), set()).add(parts[0][1])
        assert parts[0][1] not in {p[1].lower() for p in people} and parts[0][0] not in {p[0].lower() for p in people}
    made = [next(iter(s)) for s in seen.values()]
    assert all(len(s) == 1 for s in seen.values()) and len(set(made)) == len(made)
