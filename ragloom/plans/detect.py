"""The twin of language detection, as CTEs over any view of texts."""

from __future__ import annotations

from ragloom.functions.numeric import round_half_up_sql as rhu_sql
from ragloom.operators import langdetect

_TRI = "list_transform(range(1, length(s) - 1), lambda i: substring(s, i, 3))"


def _padded(cols: str, text: str, view: str) -> str:
    return (f"(SELECT {cols}, ' ' || w || ' ' AS s FROM "
            f"(SELECT {cols}, unnest({langdetect.words_sql(text)}) AS w FROM {view}))")


def detect_ctes(view: str, ids: tuple[str, ...], text: str, deps: tuple[str, ...] = ()) -> dict:
    """name -> (dependencies, body); ``best`` has the ids and lang of every text with letters."""
    cols = ", ".join(ids)
    same = lambda a, b: " AND ".join(f"{a}.{c} = {b}.{c}" for c in ids)
    return {
        "mc": ((), f"""
            SELECT lang, {langdetect.slot_sql('g')} AS slot, count(*) AS n
            FROM (SELECT lang, unnest({_TRI}) AS g FROM {_padded('lang', 'text', 'documents')}) WHERE lang IS NOT NULL GROUP BY ALL"""),
        "bases": (("mc",), "SELECT lang, ln(sum(n) + (SELECT count(DISTINCT slot) FROM mc)) AS base FROM mc GROUP BY lang"),
        "tg": (deps, f"""
            SELECT {cols}, {langdetect.slot_sql('g')} AS slot, count(*) AS c
            FROM (SELECT {cols}, unnest({_TRI}) AS g FROM {_padded(cols, text, view)}) GROUP BY ALL"""),
        "ng": (("tg",), f"SELECT {cols}, sum(c) AS n_grams FROM tg GROUP BY ALL"),
        "known": (("tg", "mc"), f"""
            SELECT {', '.join('tg.' + c for c in ids)}, mc.lang, sum(tg.c * ln(mc.n + 1)) AS hit
            FROM tg JOIN mc ON mc.slot = tg.slot GROUP BY ALL"""),
        "scored": (("ng", "bases", "known"), f"""
            SELECT {', '.join('ng.' + c for c in ids)}, b.lang, coalesce(k.hit, 0.0) - ng.n_grams * b.base AS score
            FROM ng JOIN bases b ON true LEFT JOIN known k ON {same('k', 'ng')} AND k.lang = b.lang"""),
        "best": (("scored",), f"""
            SELECT {cols}, lang FROM (
              SELECT *, row_number() OVER (PARTITION BY {cols} ORDER BY {rhu_sql('score', 6)} DESC, lang DESC) AS r FROM scored)
            WHERE r = 1"""),
    }
