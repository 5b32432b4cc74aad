"""Small fixtures for the training-data operators."""

import random
import re

WORD = re.compile(r"[^\x20\x09-\x0D]+")
DOCS = "doc_id long, text string, lang string, source string, n_chars long, size string, component_id string, target string, _h int"
SYLLABLES = {"en": "th er on an re he in ed nd ha".split(), "de": "sch ung ein ver lich keit zu ge be ach".split()}


def prose(rng: random.Random, lang: str, n: int) -> str:
    return " ".join("".join(rng.choice(SYLLABLES[lang]) for _ in range(rng.randint(1, 4))) for _ in range(n))


def rows(texts, langs=None, sources=None):
    """Rows with columns beyond those that are read, some with names that the operators use themselves."""
    return [(i, t, langs[i] if langs else None, sources[i] if sources else None, None if t is None else len(t), "x", "y", "z", 1) for i, t in enumerate(texts)]


def frame(spark, data, parts=3):
    return spark.createDataFrame(data, DOCS).repartition(parts)


def words(text):
    return WORD.findall(re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


ODD = [None, "", " \n\t ", "...", "a", "a b", "A B", "é ñ", "x" * 5000, "word " * 3000, "same text here now again", "same text here now again", "\x01\x00 odd 　 wide space", "<|endoftext|> </s> <unk>"]
