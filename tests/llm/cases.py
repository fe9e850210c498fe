"""Rows that every operator must stand: nulls, empty and long texts, ties,
repeated rows, columns whose names operators use inside."""

import re

WORD = re.compile("[^\x20\x09-\x0D]+")
LONG = " ".join(f"wort{i % 977} and{i % 13}" for i in range(6000))
NEAR = " ".join(f"same{i}" for i in range(60))
SCHEMA = ("doc_id long, text string, lang string, source string, n_chars long, id string, n int, h int, size string, kept string, "
          "part int, score string, bands string, words int, label int")
TEXTS = [None, "", " \t\n", "one two", "one  two", NEAR, NEAR + " tail", NEAR, LONG, LONG + " end", "A b c d e f g h", "a B C d e f g h",
         "x" * 30000, "éà ñ 中文 Σς", "1 2 3 !!! ###", NEAR.upper()]


def edge_rows():
    rows = [(i, t, "en" if i % 3 else None, f"s{i % 2}" if i % 4 else None, None if t is None else len(t), "x", 1, 2, "y", "z", 3, "w", "v", 4, 5)
            for i, t in enumerate(TEXTS)]
    return rows + [rows[5], rows[3]] + [(None, "null id text here", "en", "s1", 17) + (None,) * 10]


def edge(spark):
    return spark.createDataFrame(edge_rows(), SCHEMA)


def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def words(text):
    return WORD.findall(text or "")


def lowered(text):
    return (text or "").translate({65 + i: 97 + i for i in range(26)})


def shingles(text):
    w = words(lowered(text))
    return {tuple(w[k:k + 5]) for k in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(sets, percent):
    """Smallest reachable id under 100 * intersection >= percent * union."""
    from collections import defaultdict
    holds = defaultdict(list)
    for i, s in sets.items():
        for g in s:
            holds[g].append(i)
    common = defaultdict(int)
    for own in holds.values():
        own.sort()
        for k, a in enumerate(own):
            for b in own[k + 1:]:
                common[a, b] += 1
    root = {i: i for i in sets}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for (a, b), c in common.items():
        if 100 * c >= percent * (len(sets[a]) + len(sets[b]) - c):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    return {i: find(i) for i in sets}
