"""Registry of every plan: ``queries()`` and ``oracle_sql()`` are built here."""

from __future__ import annotations

from corpusdelta.plans import corpus_plans, features_plans, lexical, lexical2, selection_plans, senses_plans, vector_plans

MODULES = [lexical, lexical2, features_plans, corpus_plans, vector_plans, selection_plans, senses_plans]


def all_plans() -> dict:
    out = {}
    for m in MODULES:
        for k, v in m.PLANS.items():
            if k in out:
                raise ValueError(f"duplicate plan {k}")
            out[k] = v
    return out


def queries() -> dict:
    return {k: fn for k, (fn, _) in all_plans().items()}


def oracle_sql() -> dict:
    return {k: sql for k, (_, sql) in all_plans().items() if sql is not None}
