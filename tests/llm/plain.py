"""Brute-force versions in plain Python, and small tables with the odd cases."""

import re

SPACE = re.compile(r"[\x20\t-\r]+")


def lower_ascii(text):
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def space_words(text):
    return [w for w in SPACE.split(lower_ascii(text or "")) if w]


def alnum_words(text):
    return re.findall(r"[a-z0-9\x80-\U0010ffff]+", lower_ascii(text or ""))


def odd_texts():
    """Null, empty, white space, one word, ties, repeats, non-ASCII, very long."""
    long = " ".join(f"w{i % 977} v{i % 1013}" for i in range(30_000))
    return [None, "", " \n\t ", "one", "One  ONE\tone", "é ß 漢字 Ünï", "a b c d e", "a b c d e", long, long, long + " tail"]
