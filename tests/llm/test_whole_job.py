"""Cases in which an operator once did less than its whole job, against brute force."""

import random
import textwrap

import public_tokenizers
from tokenizers import Tokenizer

from lodestone.llm import fuzzy_lines, licenses
from lodestone.llm.token_counts import token_counts


def test_token_counts_of_odd_white_space(spark):
    """Pieces with line ends and returns inside, and pieces of more than 255 tokens."""
    path = public_tokenizers.path("byte_bpe_50k.json")
    own = Tokenizer.from_file(path)
    lots = random.Random(11)
    parts = ["a", "b", " ", " ", "\n", "\r", "\r\r", "\t", "é", "\U0001f40c" * 3, "1", "'s", "\u2003", "x" * 70]
    texts = ["foo a\r\rb bar", "foo a\nb bar", "see " + "\U0001f40c" * 64 + " end " + "\U00012345" * 64 + " x", "ab" * 3000 + " c"]
    texts += ["".join(lots.choice(parts) for _ in range(lots.randrange(80))) for _ in range(600)]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    for r in token_counts(docs, path).collect():
        assert r.n_tokens == len(own.encode(texts[r.doc_id], add_special_tokens=False).ids)


def test_short_lines_are_deduplicated(spark):
    texts = [
        "Les.\nfirst long line of this document, which stays\n}",
        "  les.\n\nAll rights reserved.\n}",
        "ALL RIGHTS RESERVED.\nAll rights reserved..\nAnd ornd.\n \nx",
        "And ornd.\nX\t\nand ormd.\nonly here",
        None,
    ]
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = {r.doc_id: r.text for r in fuzzy_lines.dedup_lines(docs).collect()}

    def shingles(line):
        return {line[k : k + fuzzy_lines.SHINGLE] for k in range(len(line) - fuzzy_lines.SHINGLE + 1)}

    def near(a, b):
        x, y = shingles(a), shingles(b)
        return a == b or (x & y and 100 * len(x & y) >= fuzzy_lines.PERCENT * len(x | y))

    # no chains here: a line goes if it is near an earlier one; blank lines stay
    seen, expected = [], {4: None}
    for k, text in enumerate(texts[:-1]):
        kept = []
        for line in text.split("\n"):
            plain = line.strip().lower()
            if not plain or not any(near(plain, other) for other in seen):
                kept.append(line)
            seen += [plain] * bool(plain)
        expected[k] = "\n".join(kept)
    assert found == expected
    assert expected[1] == "\nAll rights reserved." and expected[3] == "and ormd.\nonly here"


MIT = (
    "Permission is hereby granted, free of charge, to any person obtaining a copy of this software and associated "
    'documentation files (the "Software"), to deal in the Software without restriction, including without limitation '
    "the rights to use, copy, modify, merge, publish, distribute, sublicense, and/or sell copies of the Software"
)
BSD = (
    "Redistribution and use in source and binary forms, with or without modification, are permitted provided that "
    "the following conditions are met:"
)
GPL = (
    "This program is free software: you can redistribute it and/or modify it under the terms of the GNU General "
    "Public License as published by the Free Software Foundation, either version 3 of the License, or (at your "
    "option) any later version."
)


def test_wrapped_license_headers(spark):
    lgpl = GPL.replace("program", "library").replace("GNU", "GNU Lesser")
    prose = "plain words of a text about nothing at all, as it goes on and on for a while\n" * 30
    texts = [prose]
    for mark, width in (("", 72), ("# ", 60), (" * ", 40), ("// ", 78)):
        for text in (MIT, BSD, GPL, lgpl):
            header = "\n".join(mark + part for part in textwrap.wrap(text, width))
            texts.append(prose + header + "\n" + prose if mark == "" else f"{mark}x\n{mark.rstrip()}\n{header}\n")
    texts.append("\n".join(textwrap.wrap(MIT, 70)) + "\n\n" + "\n".join(textwrap.wrap(BSD, 70)))
    texts.append("\n".join(textwrap.wrap(GPL.replace("version 3", "version 2"), 70)))
    docs = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    found = [r for r in licenses.license_scan(docs).orderBy("doc_id").collect()]
    names = ["mit", "bsd-3-clause", "gpl-3.0", "lgpl-3.0"]
    assert [r.licenses for r in found] == ["", *names * 4, "bsd-3-clause,mit", ""]
    assert all(r.n_licensed == 1 and r.n_unknown == 0 for r in found[1:17]) and found[17].n_licensed == 2


def test_columns_named_like_results_or_inner_ones(spark):
    from pyspark.sql import functions as F

    from lodestone.llm import mixing

    schema = "doc_id long, text string, source string, n_lines int, N_removed int, _t int, _id int, _removed int, Target double, copies string, _s int, _part int, size long"
    rows = [(k, f"line {k % 3} of some words here\nand another", "ab"[k % 2], 1, 2, 3, 4, 5, 0.5, "c", 6, 7, 4) for k in range(8)]
    docs = spark.createDataFrame(rows, schema)
    lines = fuzzy_lines.dedup_lines(docs.drop("source"))
    assert lines.columns == [c for c in docs.columns if c not in ("source", "n_lines", "N_removed")] + ["n_lines", "n_removed"]
    assert {(r.doc_id, r._id, r.copies, r.n_lines) for r in lines.collect()} == {(k, 4, "c", 2) for k in range(8)}
    assert fuzzy_lines.dedup_lines(docs.select("doc_id", "text")).columns == ["doc_id", "text", "n_lines", "n_removed"]
    mixed = mixing.mix(docs)
    assert len({c.lower() for c in mixed.columns}) == len(mixed.columns)
    found = mixed.select("doc_id", "_s", "_part", F.col("target"), "copies").collect()
    assert {(r.doc_id, r._s, r._part) for r in found} == {(k, 6, 7) for k in range(8)} and all(isinstance(r.copies, int) for r in found)
    assert mixing.emitted(mixed).columns == mixed.columns
