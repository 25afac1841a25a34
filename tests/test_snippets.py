import random
import re

from pyspark.sql import functions as F

from lorespark.operators.lexical import parse_query, snippet


def brute(text, query, size):
    """Every candidate window scored one by one."""
    pieces = re.findall(r"[^\W_]+[\W_]*", text)
    words = [re.match(r"[^\W_]+", piece).group().lower() for piece in pieces]
    if not words:
        return text
    phrases = [phrase for phrase in parse_query(query) if phrase]
    found = []
    for at in range(len(words)):
        for number, phrase in enumerate(phrases):
            run = words[at : at + len(phrase)]
            if len(run) == len(phrase) and run[:-1] == phrase[:-1] and run[-1].startswith(phrase[-1]):
                found.append((at, number, at + len(phrase)))
    begins = [at for at in range(len(words)) if at == 0 or re.search(r"[.:]", pieces[at - 1])]

    def gain(start):
        held = [one for one in found if start <= one[0] < start + size]
        different = len({one[1] for one in held})
        return different * 1000 + len(held) - different, held

    best, start = 0, 0
    for at, _, _ in found:
        value, held = gain(at)
        if value > best:
            first, last = held[0][0], max(one[2] for one in held)
            best, start = value, max(min(first - (size - (last - first)) // 2, len(words) - size), 0)
        sentence = max(begin for begin in begins if begin <= at)
        if sentence < at:
            value = gain(sentence)[0] + (120 if sentence == 0 else 100)
            if value > best:
                best, start = value, sentence
    end = min(start + size, len(words))
    body = "".join(pieces[start:end])
    head = re.match(r"[\W_]*", text).group() if start == 0 else " … "
    return head + (re.sub(r"[\W_]+$", "", body) + " … " if end < len(words) else body)


def shown(spark, texts, query, size=32):
    frame = spark.createDataFrame(list(enumerate(texts)), "n long, text string")
    return [row.s for row in frame.select("n", snippet(F.col("text"), parse_query(query), size).alias("s")).orderBy("n").collect()]


def test_against_all_windows(spark):
    chance = random.Random(12)
    words = ["eel", "eels", "cod", "river", "stone", "Grüße", "lake", "42", "net", "boat", "fish"]
    texts = [" - ".join(["", "".join(chance.choice(words) + chance.choice([" ", " ", " ", ", ", ". ", ": ", "\n"]) for _ in range(chance.randrange(120)))]) for _ in range(60)]
    texts += ["", "...", "eel", "  eel.", "no such word here " * 30]
    for query in ("eel", "river cod", "eel-cod fish", "4 stone", "absent", "?!"):
        for size in (5, 32):
            assert shown(spark, texts, query, size) == [brute(text, query, size) for text in texts], (query, size)


def test_folded_words_and_marks(spark):
    assert shown(spark, ["Über Flüsse: der Rhein était là"], "fluss") == ["Über Flüsse: der Rhein était là"]
    text = "one two three. " * 20 + "The Évian water " + "and so on " * 30
    (found,) = shown(spark, [text], "evian")
    assert "Évian" in found and found.startswith(" … ") and found.endswith(" … ")
    assert shown(spark, [None], "x") == [None]
