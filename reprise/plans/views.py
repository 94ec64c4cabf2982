"""Domain tables derived from the given input tables by plain expressions.

The inputs hold no photos, so every document becomes one image occurrence, every embedding a 64-bit fingerprint, customers
the school register, events triage marks, orders lots and runs. All rows of each input take part. ``plans/oracle.py``
states the same derivations in SQL.
"""

from __future__ import annotations

from collections.abc import Callable
from functools import cached_property

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from reprise.functions import geo, images, text
from reprise.session import once
from reprise.sources.sinks import modified

FIRST_SCHOOL = 12000000


def pick(values: list, index: Column) -> Column:
    return F.get(F.array(*[F.lit(v) for v in values]), index.cast("int"))


def micro_text(micro: Column) -> Column:
    """Micro-degrees as a decimal with six places, built from integers so that no rounding is involved."""
    size = F.abs(micro)
    return F.concat(
        F.when(micro < 0, "-").otherwise(""), F.floor(size / 1000000).cast("string"), F.lit("."),
        F.lpad((size % 1000000).cast("string"), 6, "0"),
    )


class Views:
    def __init__(self, spark: SparkSession, sf_dir: str):
        self.spark, self.sf_dir = spark, sf_dir

    def table(self, name: str) -> DataFrame:
        return self.spark.read.parquet(f"{self.sf_dir}/{name}.parquet")

    @cached_property
    def inputs(self) -> tuple:
        """What tells these inputs from others: their folder and when each table there last changed."""
        return (self.sf_dir, *modified(self.spark, self.sf_dir))

    def once(self, label: str, build: Callable[[], DataFrame]) -> DataFrame:
        """A derived table that many queries read, written by the first of them in a session."""
        return once(self.spark, self.inputs, label, build)

    @cached_property
    def digests(self) -> DataFrame:
        """doc_id, sha256 of every document. Queries look at the occurrences several times; the texts are read and hashed once."""
        return self.once("digests", lambda: self.table("documents").select(
            "doc_id", F.sha2(F.col("text").cast("binary"), 256).alias("sha256")))

    @cached_property
    def occ(self) -> DataFrame:
        d = F.col("doc_id")
        school = FIRST_SCHOOL + d % 23
        return self.digests.select(d.alias("occ_id"), school.alias("__s"), "sha256").select(
            "occ_id", "sha256",
            F.when(F.col("occ_id") % 17 != 0, F.col("__s")).alias("inep"),
            pick(["AC", "MA", "BA", "SP", "RS"], F.col("__s") % 5).alias("uf"),
            F.when(F.col("__s") % 11 == 0, text.UNKNOWN_SUPPLIER)
            .when(F.col("__s") % 4 == 0, F.concat(F.lit("RI"), F.col("__s") % 2))
            .otherwise(F.concat(F.lit("RI"), F.col("__s") % 2, F.lit(" (RI) / RE"), F.col("__s") % 5, F.lit(" (RE)")))
            .alias("fornecedor"),
            F.when(F.col("__s") % 2 == 0, "5").otherwise("4.1").alias("fase"),
            F.concat(
                F.when(F.col("occ_id") % 31 == 0, F.col("__s") + 1).otherwise(F.col("__s")), F.lit(" - "),
                pick(["AC", "MA", "BA", "SP", "RS"], F.col("__s") % 5), F.lit(" - MUN"), F.col("__s") % 11,
                F.lit(" - ESC "), F.col("__s"), F.lit(" - TIPO.pdf"),
            ).alias("pdf_filename"),
            F.concat(
                F.lit("https://cdn.example.org/"),
                F.when(F.col("occ_id") % 5 == 0, "shared").otherwise((F.col("occ_id") % 69).cast("string")), F.lit(".pdf"),
            ).alias("pdf_url"),
            (F.col("occ_id") % 12 + 1).cast("int").alias("pagina"),
            pick([1600, 1200, 2048, 1240], F.col("occ_id") % 4).alias("width"),
            pick([1200, 1600, 1153, 1754], F.col("occ_id") % 4).alias("height"),
            F.concat(F.substring("sha256", 1, 16), F.lit("_"), F.col("occ_id") % 12 + 1, F.lit("_"),
                     F.col("occ_id") % 7, F.lit(".jpg")).alias("thumb_url"),
            F.lit(None).cast("bigint").alias("phash"),
        )

    @cached_property
    def contents(self) -> DataFrame:
        """Distinct image contents with the id of their first document."""
        return self.occ.groupBy("sha256").agg(F.min("occ_id").alias("base_id"))

    @cached_property
    def content_hashes(self) -> DataFrame:
        """sha256, base_id, phash. The hash comes from an embedding plus zero to two planted bit flips."""
        return self.once("hashes", self._content_hashes)

    def _content_hashes(self) -> DataFrame:
        v = F.col("embedding")
        # The middle travels with the sum: a column of its own would be sorted out again for every component.
        start = F.struct(F.get(F.sort_array(v), F.lit(32)).alias("middle"), F.lit(0).cast("bigint").alias("bits"))
        packed = F.aggregate(v, start, lambda acc, x: F.struct(acc["middle"].alias("middle"), F.shiftleft(acc["bits"], 1).bitwiseOR(
            F.when(x >= acc["middle"], 1).otherwise(0).cast("bigint")).alias("bits")), lambda acc: acc["bits"])
        vectors = self.table("embeddings").select("vec_id", packed.alias("__bits"))
        count = self.table("embeddings").agg(F.count(F.lit(1))).scalar()
        b = F.col("base_id")

        def bit(at: Column) -> Column:
            return F.call_function("shiftleft", F.lit(1).cast("bigint"), at.cast("int"))

        flips = (
            F.when(b % 3 == 0, F.lit(0).cast("bigint")).when(b % 3 == 1, bit(b % 62))
            .otherwise(bit(b % 62).bitwiseOR(bit((b + 7) % 62)))
        )
        return (
            self.contents.withColumn("vec_id", b % count).join(vectors, "vec_id")
            .select("sha256", "base_id", F.col("__bits").bitwiseXOR(flips).alias("phash"))
        )

    @cached_property
    def hashed_occ(self) -> DataFrame:
        return self.occ.drop("phash").join(self.content_hashes, "sha256")

    @cached_property
    def stamps(self) -> DataFrame:
        """sha256, base_id, stamped text: clean and damaged coordinate readings."""
        b = F.col("base_id")
        place = b % 69
        lat = -(20000000 + place * 137911) - F.floor(b / 69) % 11 * 20 - F.when(b % 10 == 7, 3000).when(
            b % 10 == 6, 90000).otherwise(0)
        lon = -(44000000 + place * 211313) + F.floor(b / 69) % 7 * 20
        plain = F.concat(micro_text(lat), F.lit("°, "), micro_text(lon), F.lit("°"))
        shown = (
            F.when(b % 10 == 3, F.concat(F.replace(micro_text(lat), F.lit("."), F.lit(",")), F.lit(" S 、 "),
                                         F.replace(micro_text(lon), F.lit("."), F.lit(",")), F.lit(" W")))
            .when(b % 10 == 4, F.concat(micro_text(-lat), F.lit("° S "), F.lit("- "), micro_text(-lon), F.lit("° O")))
            .when(b % 10 == 5, F.concat(micro_text(lat + 20000000), F.lit("° , "), micro_text(lon), F.lit("°")))
            .when(b % 10 == 8, F.concat(F.lit("protocolo "), b))
            .when(b % 10 == 9, F.concat(F.lit("51.500100 N, 10.120000 E | "), plain))
            .otherwise(plain)
        )
        return self.contents.select("sha256", "base_id", shown.alias("texto"))

    @cached_property
    def coordinates(self) -> DataFrame:
        """Reading cache: one row per image that was read; null lat/lon means nothing was found."""
        # Written, so that a filter on lat or lon does not work the reading out again.
        return self.once("coordinates", lambda: self.stamps.select("sha256", geo.extract_coordinate(F.col("texto")).alias("__p")).select(
            "sha256", "__p.lat", "__p.lon"
        ))

    @cached_property
    def measures(self) -> DataFrame:
        """One row of image measures per content; every rule of the classifier is reached, one share is unmeasured."""
        b = F.col("base_id")
        known = lambda c: F.when(b % 13 != 0, c)
        return self.contents.select(
            "sha256", "base_id",
            known(F.when(b % 19 == 0, 320).otherwise(pick([1600, 1200, 2048, 1240], b % 4))).alias("largura"),
            known(F.when(b % 19 == 0, 200).otherwise(pick([1200, 1600, 1153, 1754], b % 4))).alias("altura"),
            known(pick([0.0, 0.004, 0.016, 0.3, 0.0], b % 5)).alias("uniformidade"),
            known(F.when(b % 7 < 5, 0.4).otherwise(0.8)).alias("chapado"),
            known(F.when(b % 11 == 0, 1.0).otherwise(7.5)).alias("gradiente"),
            known(F.when(b % 4 == 1, 0.9).otherwise(0.3)).alias("branco"),
            known((b % 6) * F.lit(4.0)).alias("saturacao"),
            known(F.when(b % 3 == 0, 4).otherwise(120)).alias("cores"),
        )

    def _classified(self, rows: DataFrame, stamped) -> DataFrame:
        return rows.select("sha256", images.classify(
            F.col("largura"), F.col("altura"), F.col("uniformidade"), F.col("chapado"), F.col("gradiente"),
            F.col("branco"), F.col("saturacao"), F.col("cores"), stamped).alias("classe"))

    @cached_property
    def classes(self) -> DataFrame:
        """sha256 -> class, the stamp deciding before the texture."""
        return self._classified(self.measures.join(self.coordinates, "sha256", "left"), F.col("lat").isNotNull())

    @cached_property
    def texture_classes(self) -> DataFrame:
        """sha256 -> class by texture alone, which decides what is grouped by likeness."""
        return self._classified(self.measures, F.lit(False))

    @cached_property
    def line_occ(self) -> DataFrame:
        """Order lines as occurrences: the part is the image, its supplier the school. Sixty times the document set."""
        s = F.col("l_suppkey")
        return self.table("lineitem").select(
            F.xxhash64(*self.table("lineitem").columns).alias("occ_id"),
            F.sha2(F.col("l_partkey").cast("string"), 256).alias("sha256"), (FIRST_SCHOOL + s).alias("inep"),
            F.concat(F.lit("REDE (RI) / RE"), s % 5, F.lit(" (RE)")).alias("fornecedor"),
            F.concat(F.lit("arquivo"), s, F.lit(".pdf")).alias("pdf_filename"), F.col("l_linenumber").alias("pagina"))

    # ------------------------------------------------------------------------------------------ register and its export

    @cached_property
    def register(self) -> DataFrame:
        k = F.col("c_custkey")
        ri, re_ = F.concat(F.lit("RI"), k % 7), F.concat(F.lit("RE"), k % 11)
        both, only_ri, none = k % 3 == 0, k % 3 == 1, k % 29 == 0
        start = F.lit("2024-01-01 00:00:00").cast("timestamp")
        books = F.filter(
            F.transform(F.array(*[F.lit(i) for i in range(3)]), lambda i: F.when(
                i < k % 4, F.concat(F.lit("https://cdn.example.org/"), k, F.lit("_"), i, F.lit("%20a+b.pdf?v="), i))),
            lambda u: u.isNotNull())
        return self.table("customer").select(
            F.concat(F.lit("key_"), k).alias("escola_id_bubble"), (FIRST_SCHOOL + k).alias("inep"),
            pick(["AC", "MA", "BA", "SP", "RS"], k % 5).alias("uf"),
            F.when(none, None).when(both, F.concat(ri, F.lit(" (RI) / "), re_, F.lit(" (RE)"))).when(only_ri, ri)
            .otherwise(re_).alias("fornecedor"),
            F.when(none, None).when(both, "RI / RE").when(only_ri, "RI").otherwise("RE").alias("tipo_fornecedor"),
            F.col("c_mktsegment").alias("status_geral"),
            F.when(k % 37 == 0, "Piloto").otherwise((k % 5 + 1).cast("string")).alias("fase"), books.alias("books"),
            F.timestamp_add("HOUR", (k % 1000).cast("int"), start).alias("atualizacao"),
            F.when(k % 6 != 0, F.timestamp_add("DAY", (k % 300).cast("int"), start)).alias("ativacao_rede_externa"),
            F.lit(None).cast("timestamp").alias("ativacao_rede_interna"),
        )

    @cached_property
    def export_raw(self) -> DataFrame:
        """The next register export as text, with edits, new school ids and untidy fields."""
        k = F.col("c_custkey")
        cur = self.register.select(
            F.substring("escola_id_bubble", 5, 20).cast("bigint").alias("c_custkey"), "inep", "uf", "status_geral", "fase",
            "atualizacao", "ativacao_rede_externa", "books")
        stamp = F.date_format("atualizacao", "yyyy-MM-dd HH:mm:ss")
        return cur.select(
            F.when(k % 17 == 0, F.col("inep") + 50000000).otherwise(F.col("inep")).cast("string").alias("INEP"),
            F.when(k % 10 == 0, F.concat(F.lit(" "), F.lower("uf"), F.lit(" "))).otherwise(F.col("uf")).alias("UF"),
            F.when((k % 29 != 0) & (k % 3 != 2), F.concat(F.when(k % 7 == 0, "RIX").otherwise("RI"), k % 7))
            .alias("fornecedor_ri"),
            F.when((k % 29 != 0) & (k % 3 != 1), F.concat(F.lit(" RE"), k % 11)).otherwise(" ").alias("fornecedor_re"),
            F.when(k % 37 == 0, F.col("fase")).otherwise(F.concat("fase", F.lit(".0"))).alias("FASE"),
            F.when(k % 23 == 0, " ").otherwise(F.col("status_geral")).alias("Status Geral"),
            F.when(k % 8 == 0, F.concat(F.array_join("books", ", "), F.lit(", //cdn.example.org/extra.pdf"))).otherwise(
                F.array_join("books", ",")).alias("Books"),
            F.when(k % 41 == 0, "sem data").when(k % 9 == 0, F.date_format("atualizacao", "MM/dd/yyyy HH:mm")).otherwise(
                stamp).alias("Atualizacao"),
            F.date_format("ativacao_rede_externa", "yyyy-MM-dd").alias("Ativação Rede externa"),
            F.lit(None).cast("string").alias("Ativação Rede interna"),
        )

    # --------------------------------------------------------------------------------------------------- triage and lots

    @staticmethod
    def _pair_columns(x: Column, y: Column) -> list[Column]:
        a, b = FIRST_SCHOOL + x % 23, FIRST_SCHOOL + y % 23
        lo, hi = F.least(a, b), F.greatest(a, b)
        hi = F.when(lo == hi, hi + 1).otherwise(hi)
        return [lo.alias("inep_a"), hi.alias("inep_b"), text.pair_id(lo, hi).alias("par_id")]

    @cached_property
    def mark_events(self) -> DataFrame:
        e, kind = F.col("event_id"), F.col("event_type")
        codes = ["mesma_escola", "material_comum", "equipamento_igual", "erro_sistema", "conferido_ok", ""]
        return self.table("events").select(
            "event_id", "event_type", "ts", *self._pair_columns(F.col("user_id"), F.col("user_id") * 7 + 3)
        ).select(
            F.lit("fase5_todos").alias("run_id"), "par_id", "ts", e.alias("seq"),
            F.when(kind.isin("click", "signup", "error"), True).when(kind == "purchase", False).alias("falso_positivo"),
            F.when(kind == "click", pick(codes, e % 6)).when(kind == "error", F.lit("xx")).alias("motivo_codigo"),
            F.when(e % 3 == 0, F.concat(F.lit("nota "), e)).when(e % 3 == 1, "").alias("motivo"),
            F.when(kind == "view", e % 2 == 0).alias("mae_filho"),
            F.when(e % 5 != 0, F.col("inep_a")).alias("inep_a"), F.when(e % 5 != 0, F.col("inep_b")).alias("inep_b"),
            F.when(e % 4 == 0, "").otherwise(F.concat(F.lit("user"), e % 5)).alias("autor"),
        )

    @cached_property
    def legacy_marks(self) -> DataFrame:
        return self.table("labels").select("quality", *self._pair_columns(F.col("doc_id"), F.col("doc_id") * 5 + 1)).groupBy(
            "par_id").agg(F.bool_or(F.col("quality") == 0).alias("falso_positivo")).withColumn(
            "marcado_em", F.lit("2024-01-01 00:00:00"))

    @cached_property
    def lot_requests(self) -> DataFrame:
        """Pairs asked for per month; some requests are blank, many repeat."""
        key = F.col("o_orderkey")
        rows = self.table("orders").select(
            "o_orderkey", "o_orderdate", *self._pair_columns(F.col("o_custkey"), F.floor(key / 5)))
        return rows.select(
            F.concat(F.lit("aud_"), F.date_format("o_orderdate", "yyyyMM")).alias("envio_id"),
            F.when(key % 19 == 0, "").otherwise(F.col("par_id")).alias("par_id"), key.alias("posicao"))

    @cached_property
    def forwarded(self) -> DataFrame:
        """Lines of earlier lots."""
        k = F.col("n_nationkey").cast("bigint")
        return self.table("nation").select((FIRST_SCHOOL + k * 9).alias("inep_a"), (FIRST_SCHOOL + k * 9 + 4).alias("inep_b")
                                           ).withColumn("par_id", text.pair_id(F.col("inep_a"), F.col("inep_b")))

    @cached_property
    def uploads(self) -> DataFrame:
        """Documents handed in for lots."""
        d = F.col("doc_id")
        return self.table("documents").select(
            F.concat(F.lit("aud_"), d % 12).alias("envio_id"), (FIRST_SCHOOL + d % 23).alias("inep"),
            F.concat(F.lit("Laudo técnico nº "), d, F.lit(" – revisão."), pick(
                ["pdf", "PDF", "docx", "exe", "", "zip", "jpeg"], d % 7)).alias("arquivo_nome"),
            F.when(d % 53 == 0, F.lit(0).cast("bigint")).otherwise(F.col("n_chars") * 1500).alias("tamanho_bytes"),
            F.sha2(F.col("text").cast("binary"), 256).alias("sha256"),
            F.timestamp_add("MINUTE", (d % 500000).cast("int"), F.lit("2025-01-01 00:00:00").cast("timestamp_ntz"))
            .alias("criado_em"),
        )

    @cached_property
    def disk_runs(self) -> DataFrame:
        status = F.max("o_orderstatus")
        return self.table("orders").groupBy("o_custkey").agg(
            F.min("o_orderdate").alias("__t"), status.alias("__s")).select(
            F.concat(F.lit("fase5_todos_"), F.col("o_custkey")).alias("run_id"), F.lit("disco").alias("fonte"),
            F.when(F.col("__s") == "F", "concluido").when(F.col("__s") == "O", "processando").otherwise("erro").alias("status"),
            F.date_format("__t", "yyyy-MM-dd HH:mm:ss").alias("iniciado_em"))

    @cached_property
    def stored_runs(self) -> DataFrame:
        return self.table("supplier").select(
            F.concat(F.lit("fase5_todos_"), F.col("s_suppkey") * 3).alias("run_id"), F.lit("banco").alias("fonte"),
            F.lit("concluido").alias("status"), F.lit("2026-01-01 00:00:00").alias("iniciado_em"))
