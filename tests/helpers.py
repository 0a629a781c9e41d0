import re


def plan(df) -> str:
    return df._jdf.queryExecution().executedPlan().toString()


def rows(df, *order):
    return [tuple(r) for r in (df.orderBy(*order) if order else df).collect()]


def has_node(text: str, name: str) -> bool:
    return re.search(rf"\b{name}\b", text) is not None
