r"""Quality rules by line-first cleaning.

Each line with a word is judged by itself. It fails if
* it does not end a sentence and has fewer than LONG_LINE_WORDS words (punctuation),
* most of its words are shouted: more than one `!` for two words (punctuation),
* separators of navigation rows stand for one of four words or more (navigation),
* symbols are one for five words or more (navigation),
* it holds a notice of rights, licences, cookies or sign-ups in one of four languages (boilerplate),
* it has ten words or more and fewer than a third of them are different (boilerplate).
Failing lines are removed. A document is rejected if its base counts fail, or
if the removed lines held more than `max_lost` of its word characters.

Words are runs of characters other than space and \t \n \v \f \r, lines are cut at \n. Windows of words are compared
by 64-bit hashes.

Defined cases: a null or blank text has no words and fails; repeated rows are judged alike;
an empty table gives an empty result; other columns are passed through by clean() untouched,
except n_chars where there is one. A document whose base counts fail has no clean_text.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from beamquarry.llm.common import SPACES

#: Characters that end a sentence, closers after them, separators of navigation rows, symbols.
ENDS, CLOSERS, RAILS, SYMBOLS = ".!?:;…。！？", "\"'”’»)]", "|»›•·>", "#*$%&|<>"
#: Notices that mark a line as boilerplate, in lower case, by language; the last row is for any.
NOTICES = {
    "en": ("all rights reserved", "cookie policy", "use of cookies", "enable javascript", "licensed under", "released under the", "privacy policy",
           "our newsletter", "terms of service", "terms of use"),
    "de": ("alle rechte vorbehalten", "verwendet cookies", "javascript aktivieren", "lizenziert unter", "datenschutzerklärung", "unseren newsletter",
           "allgemeine geschäftsbedingungen", "nutzungsbedingungen"),
    "fr": ("tous droits réservés", "utilise des cookies", "activer javascript", "sous licence", "politique de confidentialité", "notre newsletter",
           "mentions légales", "conditions d'utilisation"),
    "es": ("todos los derechos reservados", "utiliza cookies", "habilitar javascript", "bajo licencia", "política de privacidad", "nuestro boletín",
           "aviso legal", "condiciones de uso"),
    "any": ("©", "copyright (c)"),
}
#: Base limits: words that a document needs, and the percentage of its words in repeated windows.
MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
#: A line without a sentence's end still passes with so many words.
LONG_LINE_WORDS = 30
BLANKS = "\t\n\v\f\r"


def words(text: Column) -> Column:
    """The words of a text. Cutting at one plain character needs no regular expression."""
    spaced = reduce(lambda x, c: F.replace(x, F.lit(c), F.lit(" ")), BLANKS, text)
    return F.array_remove(F.split(spaced, " "), "")


def count_of(text: Column, characters: str) -> Column:
    return F.length(text) - F.length(reduce(lambda x, c: F.replace(x, F.lit(c), F.lit("")), characters, text))


def holds_notice(text: Column) -> Column:
    low = F.lower(text)
    return reduce(Column.__or__, [F.contains(low, F.lit(x)) for group in NOTICES.values() for x in group])


def windows(tokens: str, size: int = 3) -> Column:
    """Hashes of the runs of `size` words of the array column `tokens`, in order."""
    shifted = ", ".join(f"slice({tokens}, {k + 1}, greatest(0, size({tokens}) - {size - 1}))" for k in range(size))
    return F.expr(f"transform(arrays_zip({shifted}), x -> xxhash64(x))")


def repeated_words(hashes: str, size: int = 3) -> Column:
    """Words that lie in windows found twice or more, of the array column `hashes` of windows.

    Most texts have none, which a set of the hashes shows. Else sorting (hash, place) puts equal windows side by
    side; of the places where a neighbour is equal, each adds the words that the one before it did not cover.
    Arrays go into lambdas as their arguments, so nothing is computed once for each element.
    """
    ordered = f"sort_array(transform({hashes}, (h, i) -> struct(h AS h, i AS i)))"
    twice = """
        o -> transform(
            filter(arrays_zip(slice(o, 1, size(o)), slice(o, 2, size(o)), concat(array(cast(NULL AS struct<h: bigint, i: int>)), o)),
                   t -> t.`0`.h = t.`1`.h OR t.`0`.h = t.`2`.h),
            t -> t.`0`.i)
    """
    covered = f"""
        aggregate(sort_array(flatten(transform(array({ordered}), {twice}))),
                  named_struct('n', 0L, 'last', -{size}),
                  (a, p) -> named_struct('n', a.n + least({size}, p - a.last), 'last', p),
                  a -> a.n)
    """
    return F.expr(f"CASE WHEN size(array_distinct({hashes})) = size({hashes}) THEN 0L ELSE {covered} END")


def line_passes(line: Column, any_of: Callable[[str], Column] = lambda kind: F.lit(True)) -> Column:
    """Whether a line with words is kept. `any_of` tells what its text holds at all: most texts need no closer look."""
    end = F.right(F.rtrim(line, F.lit(" " + BLANKS + CLOSERS)), F.lit(1))

    def judged(tokens: Column) -> Column:
        n = F.size(tokens)
        prose = (F.instr(F.lit(ENDS), end) > 0) & (end != "")
        stuck = (n >= 10) & (F.size(F.array_distinct(tokens)) * 3 < n)
        return (
            (prose | (n >= LONG_LINE_WORDS))
            & ~(any_of("shout") & (count_of(line, "!") * 2 > n))
            & ~(any_of("rail") & (count_of(line, RAILS) * 4 >= n))
            & ~(any_of("symbol") & (count_of(line, SYMBOLS) * 5 >= n))
            & ~stuck
            & ~(any_of("notice") & holds_notice(line))
        )

    # the words are an argument of a lambda, so they are made once
    return F.element_at(F.transform(F.array(words(line)), judged), 1)


def assess(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """All columns of docs and: n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words, base_failed, kept, clean_text."""
    text = F.coalesce(F.col("text"), F.lit(""))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * F.col("n_words"))
    blank = f"^[{SPACES}]*$"
    lines = F.filter(F.split(text, "\n"), lambda x: ~F.regexp_like(x, F.lit(blank)))
    left = F.filter(F.split(text, "\n"), lambda x: F.regexp_like(x, F.lit(blank)) | line_passes(x, lambda kind: F.col(f"_any_{kind}")))
    kept_chars = F.length(F.array_join(words(F.col("clean_text")), ""))
    return (
        docs.withColumn("_words", words(text))
        .withColumn("_windows", windows("_words"))
        .withColumn("_lines", lines)
        .withColumn("n_words", F.size("_words").cast("long"))
        .withColumn("word_chars", F.length(F.array_join("_words", "")).cast("long"))
        .withColumn("n_symbols", count_of(text, SYMBOLS).cast("long"))
        .withColumn("n_dup_lines", (F.size("_lines") - F.size(F.array_distinct("_lines"))).cast("long"))
        .withColumn("n_repeat_words", repeated_words("_windows"))
        .withColumn("base_failed", failed)
        .withColumn("_any_notice", holds_notice(text))
        .withColumn("_any_rail", reduce(Column.__or__, [F.contains(text, F.lit(c)) for c in RAILS]))
        .withColumn("_any_shout", F.contains(text, F.lit("!")))
        .withColumn("_any_symbol", F.col("n_symbols") > 0)
        .withColumn("clean_text", F.when(~F.col("base_failed"), F.array_join(left, "\n")))
        .withColumn("kept", ~F.col("base_failed") & F.coalesce(kept_chars >= (1 - max_lost) * F.col("word_chars"), F.lit(False)))
        .drop("_words", "_windows", "_lines", "_any_notice", "_any_rail", "_any_shout", "_any_symbol")
    )


def clean(docs: DataFrame, max_lost: float = 0.5) -> DataFrame:
    """The kept documents with their failing lines removed, in the columns of docs."""
    judged = assess(docs.select("text", F.struct(*docs.columns).alias("_doc")), max_lost)
    # a filter on `kept` would be pushed down and the rules evaluated in it once more; rows of a generator are not
    new_text = F.explode_outer(F.when(F.col("kept"), F.array("clean_text"))).alias("_text")
    rows = judged.select("_doc", new_text).where("_text IS NOT NULL")
    new = {"text": F.col("_text"), "n_chars": F.length("_text").cast(dict(docs.dtypes).get("n_chars", "long"))}
    return rows.select(*[new.get(c, F.col("_doc").getField(c)).alias(c) for c in docs.columns])
