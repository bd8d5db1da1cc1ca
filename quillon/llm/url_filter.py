"""URL filter: host/path rules first, then a weighted vocabulary.

An Aho-Corasick automaton finds every term of the vocabulary in the lower-cased
url; a hit counts only if the characters beside it are not letters or digits.
One strict term or ``soft_limit`` distinct soft terms reject the url. Of the
rules that fit (host or a subdomain of it, path prefix) the longest decides
before the vocabulary.

Cases: a null url, or one without ``://``, has an empty host and path and no
rule; its text is searched all the same (null: no hits, allowed). Repeated rows
are judged alike; an empty table gives no rows; further columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import DataFrame

# The vocabulary.
STRICT = ("adult", "casino", "escort", "malware", "porn", "sex", "spam", "viagra", "warez", "xxx")
SOFT = ("ads", "bet", "bets", "bonus", "cheap", "click", "deal", "farm", "free", "jackpot", "loan", "offer", "pills", "poker", "promo", "track", "win")
SOFT_LIMIT = 2
#: (host, path prefix, verdict)
RULES = (("net", "/", "block"), ("example.net", "/en/", "allow"), ("example.com", "/de/", "block"), ("org", "/fr/", "allow"))
SCHEMA = "page_id long, host string, path string, rule string, verdict string, strict_hits long, soft_hits long"
_LOWER = {c: c + 32 for c in range(65, 91)}


def automaton(strict: tuple[str, ...] = STRICT, soft: tuple[str, ...] = SOFT):
    import ahocorasick

    found = ahocorasick.Automaton()
    for weight, terms in ((1, soft), (2, strict)):
        for term in terms:
            found.add_word(term, (term, weight))
    found.make_automaton()
    return found


def hits(url: str, found) -> tuple[int, int]:
    """Distinct strict and soft terms in ``url`` that stand alone."""
    text, terms = url.translate(_LOWER), ({}, {}, {})
    word = lambda i: 0 <= i < len(text) and text[i].isascii() and text[i].isalnum()
    for end, (term, weight) in found.iter(text):
        if not word(end + 1) and not word(end - len(term)):
            terms[weight][term] = True
    return len(terms[2]), len(terms[1])


def split_url(url: str) -> tuple[str, str]:
    """Host (A-Z lower-cased) and path."""
    _, scheme, rest = url.partition("://")
    if not scheme:
        return "", ""
    for stop in "?#":
        rest = rest.partition(stop)[0]
    host, slash, path = rest.partition("/")
    return host.translate(_LOWER), slash + path


def _rule(host: str, path: str, rules) -> tuple[str, str] | None:
    fitting = [(h + p, verdict) for h, p, verdict in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    return max(fitting, key=lambda r: len(r[0]), default=None)


def judge_urls(df: DataFrame, rules=RULES, strict=STRICT, soft=SOFT, soft_limit: int = SOFT_LIMIT) -> DataFrame:
    """``df(page_id, url)`` as page_id, host, path, rule, verdict, strict_hits, soft_hits."""

    def judge(batches: Iterator) -> Iterator:
        import pyarrow as pa

        found = automaton(strict, soft)
        types = [pa.int64(), *[pa.string()] * 4, pa.int64(), pa.int64()]
        for batch in batches:
            rows = []
            for page, url in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
                host, path = split_url(url or "")
                rule = _rule(host, path, rules)
                n_strict, n_soft = hits(url or "", found)
                verdict = rule[1] if rule else "block" if n_strict or n_soft >= soft_limit else "allow"
                rows.append((page, host, path, rule and rule[0], verdict, n_strict, n_soft))
            columns = zip(*rows, strict=True) if rows else [()] * len(types)
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types, strict=True)], names=[c.split()[0] for c in SCHEMA.split(", ")])

    return df.select("page_id", "url").mapInArrow(judge, SCHEMA)


def oracle_sql() -> str:
    """The same verdicts with regular expressions, for DuckDB."""
    one = lambda term: f"(CASE WHEN regexp_matches(u, '(^|[^a-z0-9]){term}($|[^a-z0-9])') THEN 1 ELSE 0 END)"
    rules = " UNION ALL ".join(f"SELECT '{h}' AS rh, '{p}' AS rp, '{v}' AS rv" for h, p, v in RULES)
    # A-Z only: other letters keep their case
    return f"""
WITH parts AS (
  SELECT page_id, translate(coalesce(url, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS u,
         CASE WHEN strpos(url, '://') > 0 THEN regexp_extract(substr(url, strpos(url, '://') + 3), '^[^?#]*') ELSE '' END AS rest
  FROM pages),
split AS (
  SELECT page_id, u, translate(regexp_extract(rest, '^[^/]*'), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS host,
         substr(rest, length(regexp_extract(rest, '^[^/]*')) + 1) AS path FROM parts),
rules AS ({rules}),
fits AS (
  SELECT page_id, arg_max(rh || rp, length(rh || rp)) AS rule, arg_max(rv, length(rh || rp)) AS rv
  FROM split JOIN rules ON (host = rh OR ends_with(host, '.' || rh)) AND starts_with(path, rp) GROUP BY page_id),
counted AS (
  SELECT *, CAST({" + ".join(map(one, STRICT))} AS BIGINT) AS strict_hits, CAST({" + ".join(map(one, SOFT))} AS BIGINT) AS soft_hits FROM split)
SELECT page_id, coalesce(host, '') AS host, coalesce(path, '') AS path, rule,
       coalesce(rv, CASE WHEN strict_hits > 0 OR soft_hits >= {SOFT_LIMIT} THEN 'block' ELSE 'allow' END) AS verdict, strict_hits, soft_hits
FROM counted LEFT JOIN fits USING (page_id)"""
