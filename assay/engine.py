"""The session: functions, settings, queries and what they cost."""

from __future__ import annotations

import itertools
import re
import uuid
from dataclasses import replace
from typing import Any

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from assay.errors import PlanError
from assay.functions.requests import PARAMETERS, RETURNS
from assay.operators.judge import Settings, arrow_function
from assay.operators.metrics import FIELDS, Collector
from assay.plans.demand import Demand
from assay.plans.rewrite import Rewriter
from assay.plans.tree import Trees
from assay.plans.validate import check_plan
from assay.sources.provider import Provider

PREFIX = "assay."
DESCRIPTIONS = {
    "on_error": "fail ends a query at a row that can't be judged; null makes its result NULL",
    "model": "model of calls that name none",
    "cache_bytes": "bytes of replies kept for one batch; a query that needs more ends",
}
_SET = re.compile(r"\s*set\s+assay\.(\w+)\s*=\s*(?:'([^']*)'|\"([^\"]*)\"|(\S*))\s*;?\s*", re.IGNORECASE)

_EXPLAIN = re.compile(r"\s*explain\s+analyze\s+", re.IGNORECASE)


_PART = re.compile(r"""'(?:[^'\\]|\\.)*'|"(?:[^"\\]|\\.)*"|`[^`]*`|--[^\n]*|/\*.*?\*/|;""", re.DOTALL)


def statements(text: str) -> list[str]:
    """The statements of a text; semicolons in quotes and comments part nothing."""
    cuts = [m.start() for m in _PART.finditer(text) if m[0] == ";"]
    parts = [text[a:b].strip() for a, b in zip([0, *(c + 1 for c in cuts)], [*cuts, len(text)], strict=True)]
    return [p for p in parts if p]


class Result:
    """A planned query. It runs, and pays, each time its rows are asked for."""

    def __init__(self, engine: Engine, query: str, plan: Any, settings: Settings) -> None:
        self.engine, self.query, self.settings = engine, query, settings
        self._plan, self._demand = plan, Demand.of(engine.trees, plan)

    def dataframe(self) -> DataFrame:
        """A DataFrame of the rows. Under a LIMIT over judged rows they are judged now, as far as needed; else when it runs."""
        if self._demand:
            return self._demand.run(self.engine.provider, self.settings, self.query, self.engine.collector)
        return self.engine.trees.frame(self._plan)

    def collect(self) -> list:
        return self.dataframe().collect()

    def metrics(self) -> dict[str, int]:
        """Counters of all runs so far."""
        return self.engine.collector.total(self.query)

    def sites(self) -> dict[str, dict[str, int]]:
        """The same by place in the plan and function."""
        return self.engine.collector.sites(self.query)

    def explain_analyze(self) -> str:
        """Run the query; its plan and what each function cost."""
        df = self.dataframe()
        df.write.format("noop").mode("overwrite").save()
        lines = [f"Judge {name}: demand_driven={str(bool(self._demand)).lower()}, " + ", ".join(f"{k}={v}" for k, v in counts.items()) for name, counts in self.sites().items()]
        return "\n".join([*lines, self.engine.trees.plan(self.engine.trees.frame(self._plan)).toString()])


class Engine:
    def __init__(self, spark: SparkSession, provider: Provider, host: str | None = None, collector: Collector | None = None, **settings: Any) -> None:
        """``host`` is the driver's address as workers reach it; engines may share a ``collector``."""
        self.spark, self.provider = spark, provider
        self._settings = Settings(**({"model": provider.default_model} | settings))
        self.collector, self._own = collector or Collector(host or spark.conf.get("spark.driver.host", "127.0.0.1")), collector is None
        self.trees, self._count, self._name = Trees(spark), itertools.count(), uuid.uuid4().hex[:8]
        self._registered = False

    def register(self) -> Engine:
        """Install the functions in the session; an error, and no change, if one of their names is taken."""
        if self._registered:
            raise PlanError("cannot replace already registered function noul")
        for name in PARAMETERS:
            if self.spark.catalog.functionExists(name):
                raise PlanError(f"cannot replace already registered function {name}")
        self._registered = True
        self._install(self._next())
        return self

    def close(self) -> None:
        if self._registered:
            for name in PARAMETERS:
                self.spark.sql(f"DROP TEMPORARY FUNCTION IF EXISTS {name}")
        if self._own:
            self.collector.close()

    def _next(self) -> str:
        return f"{self._name}-{next(self._count)}"

    def _function(self, name: str, query: str, site: str | None = None) -> Any:
        return F.arrow_udf(arrow_function(name, self.provider, self._settings, query, self.collector.address, site), RETURNS[name])

    def _install(self, query: str) -> None:
        """Functions with the present settings: a query keeps those it was planned with."""
        for name in PARAMETERS:
            self.spark.udf.register(name, self._function(name, query))

    # settings

    def set(self, key: str, value: Any) -> None:
        key = key.removeprefix(PREFIX)
        if key not in DESCRIPTIONS:
            raise PlanError(f"unknown setting {PREFIX}{key}")
        try:
            self._settings = replace(self._settings, **{key: int(value) if key == "cache_bytes" else value})
        except Exception as e:
            raise PlanError(f"{PREFIX}{e}") from None
        if self._registered:
            self._install(self._next())

    def settings(self) -> list[tuple[str, Any, str]]:
        return [(PREFIX + k, getattr(self._settings, k), d) for k, d in DESCRIPTIONS.items()]

    # queries

    def sql(self, text: str) -> Result | None:
        """Plan a query. SET of a setting of the engine takes effect at once and gives None; EXPLAIN ANALYZE runs its query.

        Of several statements parted by semicolons, each is planned in turn with
        the settings that it finds, and the last one's result comes back; those
        before it that aren't commands are only checked.
        """
        first, *rest = statements(text) or [text]
        if rest:
            found = None
            for statement in (first, *rest):
                found = self.sql(statement)
            return found
        text = first
        if match := _SET.fullmatch(text):
            self.set(match[1], next((g for g in match.groups()[1:] if g is not None), ""))
            return None
        if match := _EXPLAIN.match(text):
            lines = self.sql(text[match.end() :]).explain_analyze().split("\n")
            return self.query(self.spark.createDataFrame([(x,) for x in lines], "plan string"))
        query = self._next()
        self._install(query)
        return self._planned(self.spark.sql(text), query)

    def query(self, df: DataFrame) -> Result:
        """A DataFrame with calls of :meth:`noul` and the others, planned like :meth:`sql`."""
        return self._planned(df, self._next())

    def _planned(self, df: DataFrame, query: str) -> Result:
        plan = self.trees.plan(df)
        if check_plan(self.trees, plan, self.provider):
            plan = Rewriter(self.trees, self._twins(query)).rewritten(plan)
        return Result(self, query, plan, self._settings)

    def _twins(self, query: str) -> Any:
        made: dict[tuple[str, str], Any] = {}

        def twin(name: str, arguments: list, place: str) -> Any:
            if (name, place) not in made:
                function = self._function(name, query, f"{place} {name}").asNondeterministic()
                made[name, place] = getattr(function, "_unwrapped", function)._judf
            null = self.trees.exprs.Literal.create(None, self.spark._jvm.org.apache.spark.sql.types.DataType.fromDDL("string"))
            return made[name, place].builder(self.trees.seq([null if a is None else a for a in arguments]))

        return twin

    # columns

    def _column(self, name: str, *arguments: Any) -> Column:
        columns = [a if isinstance(a, Column) else F.lit(None).cast("string") if a is None else F.lit(a) for a in arguments]
        return self._function(name, self._next())(*columns)

    def noul(self, state: Column, instructions: str | Column, criteria: str | Column | None = None, model: str | Column | None = None) -> Column:
        """The probability, from 0 to 1, that the answer is yes."""
        return self._column("noul", state, instructions, criteria, model)

    def choice(self, state: Column, instructions: str | Column, criteria: str | Column, model: str | Column | None = None) -> Column:
        """One of the labels that are the keys of ``criteria``, with confidence and all probabilities."""
        return self._column("choice", state, instructions, criteria, model)

    def score(self, state: Column, instructions: str | Column, criteria: str | Column, model: str | Column | None = None) -> Column:
        """A position on the ordered levels of ``criteria``, with confidence and all probabilities."""
        return self._column("score", state, instructions, criteria, model)

    def ask(self, state: Column, questions: str | Column, model: str | Column | None = None) -> Column:
        """The reply to several named questions, as it came."""
        return self._column("ask", state, questions, model)


__all__ = ["FIELDS", "Engine", "Result"]
