import hashlib
import random
import re
import string
from datetime import date, timedelta

from voxelframe.llm import pii


def luhn(s):
    digits = [int(c) for c in s if c.isdigit()][::-1]
    return sum(d if i % 2 == 0 else (2 * d) % 10 + 2 * d // 10 for i, d in enumerate(digits)) % 10 == 0


def run(spark, texts, **kw):
    df = spark.createDataFrame([(i, t, "x") for i, t in enumerate(texts)], "doc_id long, text string, marked string")
    return [r for r in sorted(pii.pseudonymise(df, **kw).collect(), key=lambda r: r.doc_id)]


def test_kinds_keep_format_and_link(spark):
    texts = [
        "card 4041894974608795, 4041-8949-7460-8795; phone +1 (988) 555-2485 ip 39.197.112.39 on 2021-03-04 or 28.02.1999 mail Dik.coc41@mail7.example.",
        "again 4041894974608795 and +1 (988) 555-2485 and 39.197.112.39 and 2021-03-04 and Dik.coc41@mail7.example",
        "no card 4041894974608796, ip 256.1.1.1, date 2021-02-30, id 12345, v1.2.3.4.5",
        None,
        "",
        "é\x01 1.2.3.4\x02 \U0001f600" + " word" * 30_000 + " 8.8.8.8",
    ]
    r = run(spark, texts)
    assert [r[0][f"n_{k}"] for k in pii.KINDS] == [2, 1, 1, 2, 1] and r[0].n_found == 7
    assert r[1].n_found == 5 and r[2].n_found == 0 and r[2].text == texts[2]
    assert r[3].text is None and r[3].n_found == 0 and r[4].text == "" and r[4].n_found == 0
    card, dashed, phone, ip, iso, dmy, mail = re.match(r"card (\d{16}), (\d{4}-\d{4}-\d{4}-\d{4}); phone (\+1 \(\d{3}\) \d{3}-\d{4}) ip ([\d.]+) on (\d{4}-\d\d-\d\d) or (\d\d\.\d\d\.\d{4}) mail ([A-Z][a-z]{2}\.[a-z]{3}\d\d@mail7\.example)\.$", r[0].text).groups()
    assert luhn(card) and luhn(dashed) and card == dashed.replace("-", "") and card != "4041894974608795"
    assert all(int(o) < 256 for o in ip.split("."))
    assert r[1].text == f"again {card} and {phone} and {ip} and {iso} and {mail}"
    assert r[5].n_ip == 2 and r[5].text.startswith("é\x01 ") and re.search(r"[0-9]\x02 \U0001f600", r[5].text) and r[5].text.count(" word") == 30_000
    other = run(spark, texts[:1], key="another")[0].text
    assert card not in other and ip not in other


def test_permutations_are_one_to_one(spark):
    for form, n in ((lambda i: f"{1 + i % 200}.{i // 200}.7.9", 2000), (lambda i: f"user{i:04d}@x.example", 2000), (lambda i: f"(555) 555-{i:04d}", 2000)):
        texts = [form(i) for i in range(n)]
        out = [r.text for r in run(spark, texts)]
        assert len(set(out)) == n and sum(a != b for a, b in zip(texts, out, strict=True)) > 0.99 * n
    df = spark.sql("SELECT id AS doc_id, date_format(date_add(date'1900-01-01', cast(id as int)), 'yyyy-MM-dd') AS text FROM range(73000)")
    out = pii.pseudonymise(df)
    assert out.where("n_date = 1").select("text").distinct().count() == 73_000


def test_values_beside_each_other(spark):
    """(text, number of each kind); all digits of the values listed must go."""
    card, other = "4111 1111 1111 1111", "5500-0000-0000-0004"
    cases = [
        (f"{card} 12/25", (1, 0, 0, 0, 0)),
        (f"{card} 123", (1, 0, 0, 0, 0)),
        (f"123 {card}", (1, 0, 0, 0, 0)),
        (f"1234 {card} 12", (1, 0, 0, 0, 0)),
        (f"{card} {other} {card} 7", (3, 0, 0, 0, 0)),
        ("3782 822463 10005 11/27 and 41111111 11111111 99", (2, 0, 0, 0, 0)),
        ("555-123-4567 555-987-6543", (0, 2, 0, 0, 0)),
        ("2024-01-15 555-123-4567", (0, 1, 0, 1, 0)),
        ("2024-01-15 2024-02-20", (0, 0, 0, 2, 0)),
        (f"{card} 192.168.0.1 {card} 2024-01-15 {card} 555.123.4567 {card} 03/25/2021", (4, 1, 1, 2, 0)),
        (f"1.2.3.4 {card} (555) 123-4567 {other}", (2, 1, 1, 0, 0)),
        ("1234567890123@mail.example 12 1234567890124.bob@mail.example", (0, 0, 0, 0, 2)),
        ("4 1 1 1 1 1 1 1 1 1 1 1 1 1 1 1", (1, 0, 0, 0, 0)),
        ("4111 1111 1111 1112 12/25, 2024-13-15 77, 13/25/2021 99/01/2021", (0, 0, 0, 0, 0)),
        ("12 " * 40_000 + card + " 12", None),
    ]
    got = run(spark, [t for t, _ in cases])
    for (text, counts), r in zip(cases, got, strict=True):
        if counts is None:
            assert r.text.endswith(" 12") and card not in r.text and r.n_card >= 1
            continue
        assert tuple(r[f"n_{k}"] for k in pii.KINDS) == counts, (text, r)
        assert (r.text == text) == (sum(counts) == 0)
        for value in (card, other, "555-123-4567", "2024-01-15", "192.168.0.1", "03/25/2021"):
            assert value not in r.text
    alone = run(spark, [card])[0].text
    assert luhn(alone) and got[0].text == f"{alone} 12/25" and got[1].text == f"{alone} 123" and got[2].text == f"123 {alone}"


def test_month_first_dates_are_one_to_one(spark):
    df = spark.sql("SELECT id AS doc_id, date_format(date_add(date'1900-01-01', cast(id as int)), 'MM/dd/yyyy') AS text FROM range(73000)").where("substr(text, 4, 2) > '12'")
    day_first = spark.sql("SELECT id AS doc_id, date_format(date_add(date'1900-01-01', cast(id as int)), 'dd/MM/yyyy') AS text FROM range(73000)")
    both = df.union(day_first)
    out = pii.pseudonymise(both).where("n_date = 1").select("text")
    assert out.count() == out.distinct().count() == both.count()


def test_sample_table(spark):
    docs = spark.read.parquet("/root/testdata/sf0.001/documents.parquet")
    before, after = {r.doc_id: r.text for r in docs.collect()}, {r.doc_id: r for r in pii.pseudonymise(docs).collect()}
    assert before.keys() == after.keys()
    pattern = re.compile(r"(?<![0-9.])(?:[0-9]{1,3}\.){3}[0-9]{1,3}(?![0-9.])|\b[0-9]{16}\b|\+1 \(\d{3}\) \d{3}-\d{4}|[\w.]+@[\w.]+")
    for i, text in before.items():
        assert len(text) == len(after[i].text) or after[i].n_ip
        if not after[i].n_found:
            assert text == after[i].text
        for m in pattern.findall(text):
            assert m not in after[i].text or not (luhn(m) or "." in m)


def test_empty(spark):
    assert pii.pseudonymise(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_every_other_character_is_kept(spark):
    """Control characters, also those the operator marks and escapes with, come back as they were."""
    texts = ["no pii \x01 here", "\x03\x04\x03\x05\x03\x06\x03", "\x01\x02\x03" * 50, "\x03\x06\x01\x04", "\x02a\x01 8.8.8.8\x01\x03\x05"]
    out = run(spark, texts)
    assert [r.text for r in out[:4]] == texts[:4] and not any(r.n_found for r in out[:4])
    assert out[4].n_ip == 1 and re.fullmatch(r"\x02a\x01 [0-9.]+\x01\x03\x05", out[4].text)


def test_the_key_comes_from_the_session(spark):
    text = ["call 555-123-4567"]
    demo = run(spark, text)[0].text
    assert demo == run(spark, text, key=pii.DEMO_KEY)[0].text
    spark.conf.set(pii.KEY_SETTING, "a secret")
    try:
        assert run(spark, text)[0].text == run(spark, text, key="a secret")[0].text != demo
    finally:
        spark.conf.unset(pii.KEY_SETTING)


def value(key, kind, turn, half, modulus):
    return int(hashlib.sha256(f"{key}|{kind}|{turn}|{half}".encode()).hexdigest()[:12], 16) % modulus


def numbers(key, kind, left, right, sizes, back=False):
    """The plain Feistel network over two numbers, or its inverse."""
    for turn in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        sign = -1 if back else 1
        if turn % 2 == 0:
            left = (left + sign * value(key, kind, turn, right, sizes[0])) % sizes[0]
        else:
            right = (right + sign * value(key, kind, turn, left, sizes[1])) % sizes[1]
    return left, right


def shifted(text, key, kind, turn, other, sign):
    digest, out = hashlib.sha256(f"{key}|{kind}|{turn}|{other}".encode()).hexdigest(), ""
    for i, c in enumerate(text):
        move = int(hashlib.sha256(f"{digest}{i}".encode()).hexdigest()[:8], 16) * sign
        alphabet = next((a for a in (string.digits, string.ascii_lowercase, string.ascii_uppercase) if c in a), None)
        out += alphabet[(alphabet.index(c) + move) % len(alphabet)] if alphabet else c
    return out


def letters(text, key, kind, back=False):
    left, right = text[: len(text) // 2], text[len(text) // 2 :]
    for turn in reversed(range(pii.ROUNDS)) if back else range(pii.ROUNDS):
        sign = -1 if back else 1
        if turn % 2 == 0:
            left = shifted(left, key, kind, turn, right, sign)
        else:
            right = shifted(right, key, kind, turn, left, sign)
    return left + right


def test_pseudonyms_are_the_plain_feistel_network(spark):
    """Every kind against a plain network, which the inverse network undoes."""
    key, rng = "k", random.Random(8)
    cards = ["".join(rng.choices(string.digits, k=n)) for n in (12, 14, 15, 18) for _ in range(5)]
    cards = [c + next(d for d in string.digits if luhn(c + d)) for c in cards]
    phones = [f"{rng.randint(200, 999)}-{rng.randint(200, 999)}-{rng.randint(0, 9999):04d}" for _ in range(20)]
    ips = [".".join(str(rng.randint(0, 255)) for _ in range(4)) for _ in range(20)]
    days = [rng.randrange(73_000) for _ in range(20)]
    dates = [str(date(1900, 1, 1) + timedelta(days=d)) for d in days]
    mails = ["".join(rng.choices(string.ascii_letters + string.digits + "._%+-", k=n)) + "@x.example" for n in range(1, 21)]
    got = [r.text for r in run(spark, cards + phones + ips + dates + mails, key=key)]

    for text, new in zip(cards, got[:20], strict=True):
        assert new[:-1] == letters(text[:-1], key, "card") and luhn(new)
        assert letters(new[:-1], key, "card", back=True) == text[:-1]
    for text, new in zip(phones, got[20:40], strict=True):
        plain, made = text.replace("-", ""), new.replace("-", "")
        assert made == letters(plain, key, "phone") and letters(made, key, "phone", back=True) == plain
    for text, new in zip(ips, got[40:60], strict=True):
        a, b, c, d = map(int, text.split("."))
        left, right = numbers(key, "ip", a * 256 + b, c * 256 + d, (65536, 65536))
        assert new == f"{left // 256}.{left % 256}.{right // 256}.{right % 256}"
        assert numbers(key, "ip", left, right, (65536, 65536), back=True) == (a * 256 + b, c * 256 + d)
    for day, new in zip(days, got[60:80], strict=True):
        left, right = numbers(key, "date", day // 292, day % 292, pii.DAYS)
        assert new == str(date(1900, 1, 1) + timedelta(days=left * 292 + right))
        assert numbers(key, "date", left, right, pii.DAYS, back=True) == (day // 292, day % 292)
    for text, new in zip(mails, got[80:], strict=True):
        local = text.split("@")[0]
        assert new == letters(local, key, "email") + "@x.example" and letters(new.split("@")[0], key, "email", back=True) == local


def test_repeated_rows_and_very_long_texts(spark):
    long = "plain words, " * 100_000 + "call 555-123-4567 " + "9" * 200_000
    df = spark.createDataFrame([(1, "call 555-123-4567"), (1, "call 555-123-4567"), (2, long)], "doc_id long, text string")
    rows = pii.pseudonymise(df).collect()
    first = [r.text for r in rows if r.doc_id == 1]
    assert len(rows) == 3 and first[0] == first[1] and [r.n_found for r in rows if r.doc_id == 2] == [1]
    assert next(r.text for r in rows if r.doc_id == 2) == long.replace("call 555-123-4567", first[0])
