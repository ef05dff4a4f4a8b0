"""Texts cut off by field limits or broken transfers, in pure SQL.

Trigrams of tokens are counted inside the texts and at their ends. A text is cut when its final trigram is frequent inside
texts and almost never ends one. Sentence marks are tokens too, so a complete sentence's last trigram holds its mark.

A cut falls inside words as often as between them, and then the final token is a fragment that only other cut texts have.
So where the last token is a word or a number, the trigram is taken with that token open: the two tokens before it,
followed by any token of its kind. Fragments then share the counts of the words they are cut from, and the rate at which
texts stop there does not rise with the number of cut texts. A trigram met too seldom to tell leans on the rate of the
kinds of its last two tokens; a sign is counted as itself and leans on that sign's rate.

What is shuffled is distinct trigrams with counts, summed map-side, and fixed-size keys of the ends; no text. Ends count
once per distinct text, or copies of one broken text would vouch for each other.
"""

from __future__ import annotations

from pyspark.sql import DataFrame

from ..session import cut

#: White space and damaged characters, of which any number may follow a cut.
DAMAGE = " \t\n\x0b\f\r�\x00"
# What exporters and transports leave behind a cut. Read from the end of the text backwards, where one
# anchored pass finds them however much there is; possessive, so that no number of them deepens the stack.
_ASIDE = r"(?:\.\.\.|…|detacnurt|tuc|erom|deunitnoc)"
MARKS = (
    rf"^(?:[\s\x{{FFFD}}\x00]*+(?:\.\.\.|…|\]\s*{_ASIDE}\s*\[|\)\s*{_ASIDE}\s*\("
    r"|(?:erom|no|gnidaer)\s+(?:daer|wohs|ees|weiv|eunitnoc|peek)|[A-Za-z0-9]{0,6}#?&|[A-Za-z]*/?<))++"
)
#: A token: one character of Chinese or Japanese, a word of other letters, a number with the marks inside it, a line end,
#: any other sign.
TOKEN = (
    r"[\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]|[\p{L}\p{M}&&[^\x{3040}-\x{30FF}\x{3400}-\x{9FFF}]]++"
    r"|[\p{N}]++(?:[.,:][\p{N}]++)*+|\n\s*+|[^\s\p{L}\p{M}\p{N}]"
)
#: On a line that opens with a sign (list items, signatures, rules, tables), a stretch of words is one token: such lines
#: are told apart by their build, and a name of several characters must not look like a sentence begun.
LISTED = r"(?m)((?:^[ \t]*(?=[^\s\p{L}\p{N}])|\G(?!^))[^\p{L}\n]*)\p{L}[\p{L}\p{M} '’-]*"

_TOKENS = r"concat(array('\n', '\n'), regexp_extract_all({0}, :token, 0))"
_FOLDED = "regexp_replace({0}, :listed, '$1\ue000')"
#: Numbers, and line ends with what blank lines follow them, are one token each.
_AS = r"CASE WHEN {0} < '!' THEN '\n' WHEN {0} >= '0' AND {0} < ':' THEN '0' ELSE {0} END AS {0}"
#: Kinds of a token, by its place in the code table: 0 line end, 1 number, 2 listed words, 3 letters, 4 sign.
_KIND = (
    r"CASE WHEN {0} = '\n' THEN 0 WHEN {0} = '0' THEN 1 WHEN {0} = '\ue000' THEN 2 WHEN {0} >= 'A' AND {0} < '[' OR {0} >= 'a' AND {0} < '{{{{'"
    " OR {0} >= 'À' AND {0} < ' ' OR {0} >= '぀' AND {0} < '＀' THEN 3 ELSE 4 END"
)
_TRIGRAM = f"xxhash64(a, b) AS pair, xxhash64(b = '0', c) AS last, 8 * ({_KIND.format('b')}) + {_KIND.format('c')} AS kinds"
_ABC = ", ".join(_AS.format(x) for x in "abc")

#: No filter stands on what the tokens are made into, here and below: it would be pushed under them and make them again.
_INSIDE = f"""
SELECT pair, last, kinds, count(*) AS n
FROM (SELECT {_TRIGRAM}
      FROM (SELECT {_ABC}
            FROM (SELECT inline_outer(arrays_zip(slice(t, 1, n), slice(t, 2, n), slice(t, 3, n))) AS (a, b, c)
                  FROM (SELECT t, greatest(size(t) - 3, 0) AS n
                        FROM (SELECT {_TOKENS.format(_FOLDED.format("text"))} AS t FROM {{docs}} WHERE text IS NOT NULL)))
            WHERE c IS NOT NULL))
GROUP BY pair, last, kinds
"""

#: Characters of the end among which its last tokens are looked for first, and how many must be left without marks.
_TAIL, _LEFT = 240, 100
_BARE = r"trim(TRAILING :damage FROM reverse(regexp_replace(reverse(trim(TRAILING :damage FROM {0})), :marks, '')))"
#: The last three tokens before marks and damage. Where the tail holds them and shows how its lines begin, only the tail is
#: taken apart, else the whole text; both give the same tokens.
_ENDS = rf"""
SELECT doc_id, source, body, tokens, {_TRIGRAM}
FROM (SELECT doc_id, source, body, tokens, {_ABC}
      FROM (SELECT doc_id, source, body, size(t) - 2 AS tokens, get(t, size(t) - 3) AS a, get(t, size(t) - 2) AS b, get(t, size(t) - 1) AS c
            FROM (SELECT doc_id, source, body, if(size(few) > 4 + midline, few, {_TOKENS.format(_FOLDED.format(_BARE.format("text")))}) AS t
                  FROM (SELECT *, {_TOKENS.format(f"CASE WHEN midline = 1 THEN bare WHEN feed > 0 THEN {_FOLDED.format('substring(bare, feed)')} END")} AS few
                        FROM (SELECT *, CASE WHEN length(bare) < {_LEFT} OR feed > 0 THEN 0
                                             WHEN left(ltrim(substring_index(left(text, length(text) - {_TAIL} + length(bare)), '\n', -1)), 1) RLIKE :word THEN 1
                                             ELSE 0 END AS midline
                              FROM (SELECT *, if(length(bare) < {_LEFT}, 0, instr(bare, '\n')) AS feed
                                    FROM (SELECT doc_id, source, text, xxhash64(text) AS body, {_BARE.format(f"right(text, {_TAIL})")} AS bare
                                          FROM {{docs}} WHERE text IS NOT NULL)))))))
"""

_JUDGED = """
WITH ends AS (SELECT pair, last, kinds, kinds % 8 AS kind, count(*) AS e FROM (SELECT DISTINCT pair, last, kinds, body FROM {ends}) GROUP BY ALL),
     open_end AS (SELECT pair, kind, sum(e) AS e FROM ends WHERE kind IN (1, 2, 3) GROUP BY ALL),
     open_inside AS (SELECT pair, kinds % 8 AS kind, sum(n) AS n FROM {inside} WHERE kinds % 8 IN (1, 2, 3) GROUP BY ALL),
     after_pair AS (SELECT pair, sum(n) AS n FROM {inside} GROUP BY pair),
     kinds_end AS (SELECT kinds, sum(e) AS e FROM ends GROUP BY kinds),
     kinds_inside AS (SELECT kinds, sum(n) AS n FROM {inside} GROUP BY kinds),
     kind_rate AS (SELECT kinds, k.e / (k.e + coalesce(i.n, 0)) AS p FROM kinds_end k LEFT JOIN kinds_inside i USING (kinds)),
     sign_end AS (SELECT last, sum(e) AS e FROM ends WHERE kind = 4 GROUP BY last),
     sign_rate AS (SELECT s.last, s.e / (s.e + sum(coalesce(i.n, 0))) AS p
                   FROM sign_end s LEFT JOIN {inside} i ON i.last = s.last GROUP BY s.last, s.e)
SELECT pair, last, kinds,
       CASE WHEN kind IN (1, 2, 3) THEN (open_e - 1 + :weight * kind_p) / (open_n + open_e - 1 + :weight)
            ELSE (e - 1 + :sign_weight * sign_p) / (if(n = 0, pair_n, n) + e - 1 + :sign_weight) END AS end_rate
FROM (SELECT x.pair, x.last, x.kinds, x.kind, x.e, coalesce(i.n, 0) AS n, coalesce(a.n, 0) AS pair_n, oe.e AS open_e, coalesce(oi.n, 0) AS open_n,
             k.p AS kind_p, coalesce(s.p, k.p) AS sign_p
      FROM ends x
      JOIN kind_rate k ON k.kinds = x.kinds
      LEFT JOIN {inside} i ON i.pair = x.pair AND i.last = x.last AND i.kinds = x.kinds
      LEFT JOIN after_pair a ON a.pair = x.pair
      LEFT JOIN open_end oe ON oe.pair = x.pair AND oe.kind = x.kind
      LEFT JOIN open_inside oi ON oi.pair = x.pair AND oi.kind = x.kind
      LEFT JOIN sign_rate s ON s.last = x.last)
"""


def truncated_texts(docs: DataFrame, doc_id: str = "doc_id", text: str = "text", source: str = "source", rate: float = 0.01, weight: float = 20.0, sign_weight: float = 1000.0) -> DataFrame:
    """(doc_id, source, end_rate, truncated) of every text with a token.

    end_rate: estimated chance that a text that goes on to this text's final trigram is over there, leaving the text itself
    out; truncated where it is below ``rate``. weight: pseudo-occurrences with which the rate of the last two tokens' kinds
    enters an open trigram; sign_weight: those of the final sign's own rate.

    Null, empty and blank texts, having no end to judge, give no row. Repeated rows each give theirs. An empty table gives
    an empty result, and columns beyond the three named are ignored.
    """
    spark = docs.sparkSession
    base = docs.selectExpr(f"`{doc_id}` AS doc_id", f"`{source}` AS source", f"`{text}` AS text")
    patterns = {"listed": LISTED, "token": TOKEN}
    inside = cut(spark.sql(_INSIDE, args=patterns, docs=base.select("text")))
    ends = cut(spark.sql(_ENDS, args={**patterns, "marks": f"(?i){MARKS}", "damage": DAMAGE, "word": r"[\p{L}\p{N}]"}, docs=base)).where("tokens > 0")
    judged = spark.sql(_JUDGED, args={"weight": weight, "sign_weight": sign_weight}, ends=ends, inside=inside)
    return spark.sql(
        "SELECT e.doc_id, e.source, j.end_rate, j.end_rate < :rate AS truncated FROM {ends} e JOIN {judged} j USING (pair, last, kinds)",
        args={"rate": rate}, ends=ends, judged=judged,
    )


def truncation_by_source(found: DataFrame) -> DataFrame:
    """(source, texts, truncated, share) from truncated_texts; a null source is a source of its own."""
    return found.sparkSession.sql(
        "SELECT source, count(*) AS texts, count_if(truncated) AS truncated, count_if(truncated) / count(*) AS share FROM {found} GROUP BY source",
        found=found,
    )
