"""Instruction text functions as native Column expressions (no UDFs).

Every function here returns a ``Column`` built from Spark SQL built-ins, so it
stays inside whole-stage codegen and Catalyst can prune and push around it.

Regex dialect notes (Python ``re`` semantics are the target):
- ``(?U)`` gives Unicode ``\\s``, ``\\w`` and ``\\b`` like Python's str patterns;
- ``(?d)`` makes ``\\n`` the only line terminator, so ``.`` and ``$`` behave as
  in Python (Java would otherwise also stop at ``\\r``, ``\\u0085``, ...);
- ``regexp_extract`` gives ``''`` on no match, so groups that cannot be empty
  are turned back into null with ``nullif``.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .. import taxonomy as tx


def _alt(words) -> str:
    return "|".join(words)


def _str_array(values) -> Column:
    return F.array(*[F.lit(v) for v in values])


# Characters Python's ``str.split()`` treats as whitespace, as a regex class
# understood by both Java and RE2.
PY_WHITESPACE_CLASS = (r"[\t\n\x0B\f\r\x1C-\x1F \x{85}\x{A0}\x{1680}"
                       r"\x{2000}-\x{200A}\x{2028}\x{2029}\x{202F}\x{205F}\x{3000}]")

ADD_HEAD_RE = (r"(?iUd)^\s*(?:" + _alt(tx.ADD_VERBS) + r")\s+(?:"
               + _alt(tx.ADD_ARTICLES) + r")?\s*(.+)$")
# Same, but an article must be a whole word ("add apple" keeps its "a").
ADD_HEAD_STRICT_RE = (r"(?iUd)^\s*(?:" + _alt(tx.ADD_VERBS) + r")\s+(?:(?:"
                      + _alt(tx.ADD_ARTICLES) + r")\s+)?\s*(.+)$")
# Unicode word boundary written out (``\b`` under ``(?U)`` is several times
# slower in Java, and plain ``\b`` changed meaning in JDK 19). The lookahead
# on the possible first letters only skips positions where no boundary word
# can start, so the first cut found is the same.
_WORD_CHAR = r"[\p{L}\p{N}_]"
_FIRST_LETTERS = "".join(sorted({w[0] for w in tx.ADD_BOUNDARY_WORDS}))
ADD_BOUNDARY_RE = (rf"(?<!{_WORD_CHAR})(?=[{_FIRST_LETTERS}])(?:" + _alt(tx.ADD_BOUNDARY_WORDS)
                   + rf")(?!{_WORD_CHAR})[\s\S]*")
NON_LETTERS_RE = "[^a-z]+"


def _searched(pattern: str) -> str:
    r"""A pattern that starts with ``\b`` and a letter, for Java: the boundary is
    written out, because Java takes signs like a raised 2 for no word character."""
    return "(?iUd)" + pattern.replace(r"\b", rf"(?<!{_WORD_CHAR})", 1)


def bind(value: Column, body) -> Column:
    """Evaluate ``value`` once and hand it to ``body`` as a lambda variable.

    A CASE that tests one computed value several times would otherwise
    recompute it in every branch (no common-subexpression elimination
    across conditional branches), here a regex + split + filter pipeline.
    """
    return F.element_at(F.transform(F.array(value), body), 1)


def null_safe_text(text: Column) -> Column:
    """A missing instruction is the empty string."""
    return F.coalesce(text, F.lit(""))


def singularize(word: Column) -> Column:
    """C4: ies (len > 4) -> y; ses/xes/hes -> drop 2; s but not ss (len > 3) -> drop 1."""
    def body(w):
        n = F.length(w)
        return (F.when(w.endswith("ies") & (n > 4), F.concat(F.left(w, n - 3), F.lit("y")))
                .when(w.endswith("ses") | w.endswith("xes") | w.endswith("hes"), F.left(w, n - 2))
                .when(w.endswith("s") & ~w.endswith("ss") & (n > 3), F.left(w, n - 1))
                .otherwise(w))
    return bind(word, body)


def add_object(instruction: Column, strict_article: bool = False) -> Column:
    """Head noun of an ``add`` instruction, or null.

    1. anchored verb + optional article, rest of the line;
    2. lower-case, cut at the first boundary word;
    3. split on non-letters;
    4. the last word that is not in the not-an-object set (popping trailing
       members is the same as taking the last non-member);
    5. singularise.
    """
    pattern = ADD_HEAD_STRICT_RE if strict_article else ADD_HEAD_RE
    rest = F.nullif(F.regexp_extract(null_safe_text(instruction), pattern, 1), F.lit(""))
    phrase = F.regexp_replace(F.lower(rest), ADD_BOUNDARY_RE, "")
    stop = _str_array(tx.NOT_AN_OBJECT)
    words = F.filter(F.split(phrase, NON_LETTERS_RE),
                     lambda w: (w != "") & ~F.array_contains(stop, w))
    return singularize(F.try_element_at(words, F.lit(-1)))


def _tune_map() -> Column:
    items = []
    for word, name in tx.TUNE_WORD_TO_TYPE.items():
        items += [F.lit(word), F.lit(name)]
    return F.create_map(*items)


def classify_tune(instruction: Column) -> Column:
    """Words on ``[^a-z]+``, scanned from the end; first listed word decides."""
    words = F.split(F.lower(null_safe_text(instruction)), NON_LETTERS_RE)
    m = _tune_map()
    hits = F.filter(F.transform(F.reverse(words), lambda w: F.try_element_at(m, w)),
                    lambda t: t.isNotNull())
    return F.try_element_at(hits, F.lit(1))


def classify_real(prompt: Column) -> Column:
    """First rule with a needle contained in the lower-cased prompt, else
    null. The prompt is lower-cased once, not once for every needle."""
    def first_rule(p: Column) -> Column:
        out = None
        for name, needles in tx.REAL_RULES:
            cond = p.contains(needles[0])
            for needle in needles[1:]:
                cond = cond | p.contains(needle)
            out = F.when(cond, F.lit(name)) if out is None else out.when(cond, F.lit(name))
        return out

    return bind(F.lower(prompt), first_rule)


def classify_real_by_rule_table(prompt: Column) -> Column:
    """The rule table as an ordered array; the first entry whose needle is
    contained wins. Same result as ``classify_real``, written as a lookup over
    the (prio, name, needle) table instead of a CASE."""
    p = F.lower(prompt)
    rules = F.array(*[F.struct(F.lit(prio).alias("prio"), F.lit(name).alias("name"),
                               F.lit(needle).alias("needle"))
                      for prio, name, needle in tx.REAL_NEEDLES])
    hits = F.filter(rules, lambda r: p.contains(r["needle"]))
    return F.try_element_at(hits, F.lit(1))["name"]


def classify_edit(edit_type: Column, instruction: Column,
                  strict_article: bool = False) -> Column:
    """(corpus edit_type, instruction) -> type name, or null to drop."""
    obj = add_object(instruction, strict_article)
    add_type = F.create_map(*[x for o in tx.ADD_OBJECTS for x in (F.lit(o), F.lit(f"add_{o}"))])
    return (F.when(edit_type == "add", F.try_element_at(add_type, obj))
            .when(edit_type == "tune_transfer", classify_tune(instruction))
            .when(edit_type.isin(*tx.WHOLE_TYPES), edit_type))


def type_id_of(name: Column) -> Column:
    """Type name -> id through a literal map (hash lookup, no join)."""
    items = []
    for i, n in enumerate(tx.TYPE_NAMES):
        items += [F.lit(n), F.lit(i).cast("bigint")]
    return F.try_element_at(F.create_map(*items), name)


def head_noun_v1(instruction: Column, edit_type: str) -> Column:
    """Earlier histogram heads: pattern *search*, last word of the group."""
    pat = {"add": tx.HEAD_V1_ADD_PATTERN, "tune_transfer": tx.HEAD_V1_TUNE_PATTERN}[edit_type]
    grp = F.nullif(F.regexp_extract(null_safe_text(instruction), _searched(pat), 1), F.lit(""))
    words = F.filter(F.split(F.lower(grp), PY_WHITESPACE_CLASS + "+"), lambda w: w != "")
    return F.try_element_at(words, F.lit(-1))


def addition_head(prompt: Column) -> Column:
    """Loose addition pattern; head is the last word unless that is a
    trailing preposition, then the first."""
    grp = F.nullif(F.regexp_extract(null_safe_text(prompt), _searched(tx.ADDITION_PATTERN), 1),
                   F.lit(""))
    words = F.filter(F.split(F.lower(grp), PY_WHITESPACE_CLASS + "+"), lambda w: w != "")

    def body(ws):
        last = F.try_element_at(ws, F.lit(-1))
        return F.when(last.isin(*tx.ADDITION_TRAILING_PREPOSITIONS),
                      F.try_element_at(ws, F.lit(1))).otherwise(last)
    return bind(words, body)


def looks_like_addition(prompt: Column) -> Column:
    return F.regexp_extract(null_safe_text(prompt), _searched(tx.ADDITION_PATTERN), 1) != ""


def raw_words(text: Column) -> Column:
    """Lower-cased words split on Python whitespace, ends stripped of ``.,!?"'``
    (empty strings kept, as the unmatched-word counter keeps them)."""
    words = F.filter(F.split(F.lower(text), PY_WHITESPACE_CLASS + "+"), lambda w: w != "")
    return F.transform(words, lambda w: F.btrim(w, F.lit(tx.PROFILE_STRIP_CHARS)))


def is_profile_word(word: Column) -> Column:
    """Kept by the word profile: longer than 2 and not a stop word."""
    return (F.length(word) > 2) & ~word.isin(*tx.PROFILE_STOP_WORDS)


def word_tokens(text: Column) -> Column:
    """Profile words of a text as an array."""
    return F.filter(raw_words(text), is_profile_word)
