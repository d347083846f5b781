"""All registered queries of the library proper."""

from __future__ import annotations

from . import anchors, base, evaluate, files, findings, parts, quality, retrieval, rules, state, structure


def flagship(spark, sf_dir):
    return base.QUERIES["topk_rrf"](spark, sf_dir)


def queries():
    return dict(base.QUERIES)


def oracle_sql():
    return dict(base.SQL)
