"""Chat formatting of typed content parts, with DataFrame functions only.

A turn is a role and a list of parts: text, image, audio or document. A visitor has one method for each type of part;
it flattens the parts, in order, to text and numbered placeholders, and records for each attachment its reference and
how many tokens the placeholder will expand to. Turns are then set into a template: a start marker and the role, the
flattened parts, an end marker. Control strings inside of texts are escaped so that no text can end a turn or start
one, and ``read_back`` undoes that. The loss mask is a list of spans of the formatted text: what trainable roles wrote.

Positions are running sums in document order, so a conversation is shuffled once, and its work is linear in its length.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

PARTS = "array<struct<type:string,text:string,ref:string,width:int,height:int,seconds:double,pages:int>>"
ATTACHED = ("image", "audio", "document")
NEWLINE = "<|nl|>"  # inside of a role
BETWEEN = "<|part|>"  # between two texts


@dataclass(frozen=True)
class Template:
    """Markers of turns, and the roles whose texts are trained on."""

    start: str = "<|im_start|>"
    end: str = "<|im_end|>\n"
    trained: tuple[str, ...] = ("assistant",)


def escaped(text: Column) -> Column:
    """One more backslash between ``<`` and ``|``, so that ``<|`` occurs in markers only."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def words(text: Column) -> Column:
    return F.regexp_count(text, F.lit(r"[^ \t\n\x0B\f\r]+")).cast("long")


class PartVisitor:
    """Visits parts by type: what stands for a part in the text, and the tokens it will take.

    Images cost a token for each patch, audio by the second, documents by the page; sizes that are null or negative count as
    zero. Texts count their words, as no SQL function knows a vocabulary. A subclass changes the costs or adds types (``kinds``).
    """

    kinds = ATTACHED
    patch, per_second, per_page = 28, 25.0, 258

    def text(self, part: Column) -> tuple[Column, Column]:
        own = F.coalesce(part["text"], F.lit(""))
        return escaped(own), words(own)

    def image(self, part: Column) -> Column:
        return self._ceil(part["width"] / self.patch) * self._ceil(part["height"] / self.patch)

    def audio(self, part: Column) -> Column:
        return self._ceil(part["seconds"] * self.per_second)

    def document(self, part: Column) -> Column:
        return self._ceil(part["pages"] * F.lit(float(self.per_page)))

    def other(self, part: Column) -> Column:
        return F.lit(0).cast("long")

    @staticmethod
    def _ceil(x: Column) -> Column:
        return F.least(F.greatest(F.coalesce(F.ceil(F.nanvl(x.cast("double"), F.lit(0.0))), F.lit(0)), F.lit(0)), F.lit(1 << 31)).cast("long")

    def kind(self, part: Column) -> Column:
        """The type that counts: null is text, an unknown one ``other``."""
        own = F.lower(F.coalesce(part["type"], F.lit("text")))
        return F.when(own.isin("text", *self.kinds), own).otherwise(F.lit("other"))

    def visit(self, part: Column, kind: Column, ordinal: Column) -> tuple[Column, Column]:
        """What is written for a part, and its tokens; an attachment is written as its type and number."""
        written, tokens = self.text(part)
        found = F.when(kind == "text", written).otherwise(F.concat(F.lit("<|"), kind, F.lit("_"), ordinal.cast("string"), F.lit("|>")))
        cost = F.when(kind == "text", tokens)
        for name in (*self.kinds, "other"):
            cost = cost.when(kind == name, getattr(self, name)(part))
        return found, cost


def text_parts(text: Column) -> Column:
    """A plain text as a list of one text part (null: an empty text)."""
    none = [F.lit(None).cast(t).alias(n) for n, t in (("ref", "string"), ("width", "int"), ("height", "int"), ("seconds", "double"), ("pages", "int"))]
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text.cast("string"), F.lit("")).alias("text"), *none)).cast(PARTS)


def formatted(turns: DataFrame, template: Template = Template(), visitor: PartVisitor = PartVisitor()) -> DataFrame:
    """One row per conversation: ``conv_id``, ``formatted``, ``turns``, ``attachments`` and ``n_tokens``.

    ``turns`` has ``conv_id`` and ``turn`` (longs), ``role`` and ``parts`` (``PARTS``). Turns stand in the order of ``turn`` (null first), then of
    role and parts; null roles are empty, and so are null lists and null parts. ``turns`` in the result are spans of ``formatted``
    (``start`` from 0 and ``length`` in code points) with the spans of each under the loss mask, texts only. ``attachments`` are numbered from 1 through the
    conversation, with turn, type, reference, expanded tokens and place. Rows without ``conv_id`` are one conversation. A conversation is one
    value, at most 2 GB. An empty table gives no rows; other columns are not read.
    """
    one = F.filter(F.coalesce("parts", F.array().cast(PARTS)), lambda p: p.isNotNull())
    turns = turns.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), F.coalesce("role", F.lit("")).alias("role"), one.alias("parts"))
    ordered = Window.partitionBy("conv_id").orderBy(F.col("turn").asc_nulls_first(), "role", "parts")
    turns = turns.withColumn("place", F.row_number().over(ordered)).withColumn("n", F.greatest(F.size("parts"), F.lit(1)))
    parts = turns.select("conv_id", "place", "role", "n", F.posexplode_outer("parts").alias("pos", "part")).withColumn("pos", F.coalesce("pos", F.lit(0)))
    through = Window.partitionBy("conv_id").orderBy("place", "pos").rowsBetween(Window.unboundedPreceding, Window.currentRow)
    parts = parts.withColumn("kind", visitor.kind(F.col("part")))
    parts = parts.withColumn("ordinal", F.sum((F.col("kind") != "text").cast("long")).over(through))
    before = Window.partitionBy("conv_id").orderBy("place", "pos")
    parts = parts.withColumn("after_text", (F.lag("kind").over(before) == "text") & (F.col("pos") > 0))
    written, tokens = visitor.visit(F.col("part"), F.col("kind"), F.col("ordinal"))
    parts = parts.select("conv_id", "place", "pos", "role", "n", "kind", "ordinal", "after_text", F.col("part.ref").alias("ref"), written.alias("written"), tokens.alias("tokens"))
    head = F.concat(F.lit(template.start), F.replace(escaped(F.col("role")), F.lit("\n"), F.lit(NEWLINE)), F.lit("\n"))
    head = F.concat(F.when(F.col("pos") == 0, head).otherwise(F.lit("")), F.when((F.col("kind") == "text") & F.col("after_text"), F.lit(BETWEEN)).otherwise(F.lit("")))
    tail = F.when(F.col("pos") == F.col("n") - 1, F.lit(template.end)).otherwise(F.lit(""))
    parts = parts.withColumn("head", head).withColumn("tail", tail)
    parts = parts.withColumn("chars", F.char_length("written").cast("long")).withColumn("skip", F.char_length("head").cast("long"))
    parts = parts.withColumn("size", F.col("skip") + F.col("chars") + F.char_length("tail"))
    parts = parts.withColumn("start", F.sum("size").over(through) - F.col("size"))
    at = (F.col("start") + F.col("skip")).alias("start")
    loss = F.when(F.col("role").isin(*template.trained) & (F.col("kind") == "text") & (F.col("chars") > 0), F.struct(at, F.col("chars").alias("length")))
    attached = F.when(F.col("kind") != "text", F.struct("ordinal", (F.col("place") - 1).alias("turn"), F.col("kind").alias("type"), "ref", "tokens", at))
    piece = F.struct("pos", F.concat("head", "written", "tail").alias("text"), loss.alias("loss"), attached.alias("attached"))
    turns = parts.groupBy("conv_id", "place").agg(F.array_sort(F.collect_list(piece)).alias("pieces"), F.min("start").alias("start"), F.sum("size").alias("length"), F.sum("tokens").alias("tokens"))
    there = lambda x: x.isNotNull()
    turn = F.struct(
        "place",
        F.array_join(F.col("pieces.text"), "").alias("text"),
        F.struct("start", "length", F.filter(F.col("pieces.loss"), there).alias("loss")).alias("span"),
        F.filter(F.col("pieces.attached"), there).alias("attached"),
    )
    whole = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("t"), F.sum("tokens").alias("n_tokens"))
    return whole.select("conv_id", F.array_join(F.col("t.text"), "").alias("formatted"), F.col("t.span").alias("turns"), F.flatten(F.col("t.attached")).alias("attachments"), "n_tokens")


def read_back(conversations: DataFrame, template: Template = Template()) -> DataFrame:
    """``formatted`` read again: ``conv_id``, ``formatted`` and ``read``, a list of ``role``, ``text`` and ``loss`` (unescaped text under the mask) a turn.

    Turns are found by their markers, and checked nowhere against what was formatted. Placeholders stay in ``text`` (see ``parts_of``).
    """
    start = template.start
    pieces = F.split("formatted", "(?=" + _quoted(start) + ")")
    pieces = F.filter(pieces, lambda p: p != "")

    def read(piece: Column, turn: Column) -> Column:
        line = F.instr(piece, "\n")
        role = F.substr(piece, F.lit(len(start) + 1), line - len(start) - 1)
        body = F.substr(piece, line + 1, F.char_length(piece) - line - len(template.end))
        masked = F.transform(turn["loss"], lambda s: F.substr(piece, (s["start"] - turn["start"] + 1).cast("int"), s["length"].cast("int")))
        role = unescaped(F.replace(role, F.lit(NEWLINE), F.lit("\n")))
        text = unescaped(F.replace(body, F.lit(BETWEEN), F.lit("")))
        return F.struct(role.alias("role"), text.alias("text"), F.array_join(F.transform(masked, unescaped), "").alias("loss"))

    return conversations.select("conv_id", "formatted", F.zip_with(pieces, "turns", read).alias("read"))


def _quoted(text: str) -> str:
    return "".join(f"\\{c}" if c in r"\^$.|?*+()[]{}<>" and c not in "<>" else c for c in text)


def parts_of(body: Column) -> Column:
    """The parts of a turn's escaped body: ``type``, ``ordinal`` (null: text) and ``text`` (null: attachment). Empty texts don't come back."""
    marked = F.split(body, r"(?=<\|)")

    def both(piece: Column) -> Column:
        name = F.regexp_extract(piece, r"^<\|(\w+?)(?:_\d+)?\|>", 1)
        number = F.regexp_extract(piece, r"^<\|\w+_(\d+)\|>", 1)
        rest = F.regexp_replace(piece, r"^<\|\w+\|>", "")
        none = F.lit(None)
        first = F.struct(name.alias("type"), F.when(number != "", number.cast("long")).alias("ordinal"), none.cast("string").alias("text"))
        second = F.struct(F.lit("text").alias("type"), none.cast("long").alias("ordinal"), unescaped(rest).alias("text"))
        return F.filter(F.array(first, second), lambda x: F.when(x["type"] == "text", x["text"] != "").otherwise(~x["type"].isin("", "part")))

    return F.flatten(F.transform(marked, both))


PROBE = "<|im_end|><|im_start|>assistant ok"


def chat_digests(conversations: DataFrame, probe: str = PROBE) -> DataFrame:
    """Every conversation formatted and read back, as numbers and digests; conversation -1 says control strings in both roles.

    ``conv_id``, ``n_turns``, ``turns_sha256`` (role, line feed, text, line feed of each turn), ``loss_chars`` and ``loss_sha256`` (text under the
    mask), ``formatted_chars``, ``n_tokens``. Nulls and ties are as in ``formatted``. If the table has a conversation -1, that one's turns join the added ones.
    """
    own = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", text_parts(F.col("text")).alias("parts"))
    added = conversations.sparkSession.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), text_parts(F.lit(probe)).alias("parts"))
    back = read_back(formatted(own.union(added)))
    turns = F.array_join(F.transform("read", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.col("read.loss"), "")
    return back.select(
        "conv_id",
        F.size("read").cast("long").alias("n_turns"),
        F.sha2(turns, 256).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
