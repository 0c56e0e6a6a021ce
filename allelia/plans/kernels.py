"""Registered queries whose last step is a numpy kernel or a distributed iteration; tests hold them against brute force."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .. import views as V
from ..operators import association as A
from ..operators import kinship as K
from ..operators import logistic as B
from ..operators import mixed as M
from ..operators import newton as N
from ..operators import setbased as T
from ..operators import summary as S
from .adjusted import dosages
from .queries import members, query


def groups(spark, sf_dir) -> DataFrame:
    """Variants by gene and chromosome."""
    return V.variants(spark, sf_dir).select(F.concat_ws("_", "gene", F.col("chrom").cast("string")).alias("group"), "variant_id")


def binary(spark, sf_dir) -> DataFrame:
    return V.samples(spark, sf_dir).withColumn("case", F.col("trait") - 1)


@query("score_binary")
def score_binary(spark, sf_dir):
    return B.logistic_score(V.calls(spark, sf_dir), binary(spark, sf_dir), "case", ["c2"])


@query("cmc_score_binary")
def cmc_score_binary(spark, sf_dir):
    return B.logistic_score(A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), "cmc"), binary(spark, sf_dir), "case", ["c2"], "group")


@query("wald_binary")
def wald_binary(spark, sf_dir):
    return B.regress(V.calls(spark, sf_dir), binary(spark, sf_dir), "case", ["sex"])


@query("firth_binary")
def firth_binary(spark, sf_dir):
    return B.regress(V.calls(spark, sf_dir), binary(spark, sf_dir), "case", ["sex"], firth=True)


def balanced(spark, sf_dir) -> DataFrame:
    """binary() with a covariate b that differs from sample to sample."""
    return binary(spark, sf_dir).withColumn("b", F.col("y").cast("double") / 700.0)


def _newton(name, firth=False):
    calls = lambda spark, sf_dir: dosages(spark, sf_dir) if name is None else A.collapse(V.calls(spark, sf_dir), members(spark, sf_dir), name)
    return lambda spark, sf_dir: N.regress(calls(spark, sf_dir), balanced(spark, sf_dir), "case", ["c1", "b"], firth, "variant_id" if name is None else "group")


query("wald_binary_dosage")(_newton(None))
query("firth_binary_dosage")(_newton(None, firth=True))
query("cmc_wald_binary")(_newton("cmc"))
query("zeggini_wald_binary")(_newton("zeggini"))


@query("kernel_tests")
def kernel_tests(spark, sf_dir):
    return T.kernel_tests(V.calls(spark, sf_dir, complete=True, by=("variant_id",)), V.samples(spark, sf_dir), groups(spark, sf_dir))


@query("kernel_tests_cov")
def kernel_tests_cov(spark, sf_dir):
    return T.kernel_tests(V.calls(spark, sf_dir, complete=True, by=("variant_id",)), V.samples(spark, sf_dir), groups(spark, sf_dir), ["c1", "c2"])


@query("family_kernel_tests")
def family_kernel_tests(spark, sf_dir):
    return T.family_kernel_tests(V.calls(spark, sf_dir, complete=True, by=("variant_id",)), V.samples(spark, sf_dir), groups(spark, sf_dir))


#: As many as the reference draws for a group; groups with 2 * alpha * REPLICATES hits stop before.
REPLICATES = 10_000


def _permutation(name):
    def run(spark, sf_dir):
        return T.permutation_test(V.calls(spark, sf_dir), binary(spark, sf_dir), groups(spark, sf_dir), name, "case", n_perm=REPLICATES)

    return run


for _name in T.STATISTICS:
    query(f"perm_{_name}")(_permutation(_name))


@query("perm_kbac_adaptive")
def perm_kbac_adaptive(spark, sf_dir):
    return T.permutation_test(V.calls(spark, sf_dir), binary(spark, sf_dir), groups(spark, sf_dir), "kbac", "case", n_perm=REPLICATES, check_every=1000)


@query("fam_score")
def fam_score(spark, sf_dir):
    return M.family_score(V.calls(spark, sf_dir, complete=True), V.samples(spark, sf_dir), "y")


@query("fam_cmc")
def fam_cmc(spark, sf_dir):
    return M.family_score(A.collapse(V.calls(spark, sf_dir, complete=True), members(spark, sf_dir), "cmc"), V.samples(spark, sf_dir), "y", group="group")


@query("fam_zeggini")
def fam_zeggini(spark, sf_dir):
    return M.family_score(A.collapse(V.calls(spark, sf_dir, complete=True), members(spark, sf_dir), "zeggini"), V.samples(spark, sf_dir), "y", group="group")


@query("infinitesimal_solve")
def infinitesimal_solve(spark, sf_dir):
    out = M.infinitesimal_solve(V.calls(spark, sf_dir, complete=True), V.samples(spark, sf_dir), "y", V.read(spark, sf_dir, "part").count(), 1.0)
    return out.select("sample_id", F.round("x", 3).alias("x"))


@query("ibs_kinship_full")
def ibs_kinship_full(spark, sf_dir):
    return K.ibs_all(V.calls(spark, sf_dir), V.samples(spark, sf_dir), V.read(spark, sf_dir, "part").count())


@query("pair_sharing_full")
def pair_sharing_full(spark, sf_dir):
    return K.pair_counts(V.calls(spark, sf_dir), V.samples(spark, sf_dir), V.read(spark, sf_dir, "part").count()).where("i < j")


@query("wide_genotypes_full")
def wide_genotypes_full(spark, sf_dir):
    return S.wide_all(V.calls(spark, sf_dir), V.variants(spark, sf_dir), V.samples(spark, sf_dir))
