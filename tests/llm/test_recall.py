"""Links of near-duplicates in the driver's table: every document with an id divisible by 20 against all documents, by full sets."""

from __future__ import annotations

import re

from verbatlas.llm import neardup

PATH = "/root/testdata/sf0.01/documents.parquet"


def test_no_link_is_missed(spark):
    docs = spark.read.parquet(PATH)
    sets = {}
    for r in docs.select("doc_id", "text").collect():
        w = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), r["text"] or ""))
        sets[r["doc_id"]] = set(zip(w, w[1:])) if len(w) > 1 else {tuple(w)} - {()}
    component = {r["doc_id"]: r["component_id"] for r in neardup.classes(docs, 2, 80).collect()}
    links = found = 0
    for a in (i for i in sets if i % 20 == 0):
        for b, items in sets.items():
            common = len(sets[a] & items)
            if a != b and common and 100 * common >= 80 * (len(sets[a]) + len(items) - common):
                links += 1
                found += component[a] == component[b]
    assert links > 5 and found == links
