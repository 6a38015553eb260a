"""SQL texts for databases: selections, tuples, keyset and incremental pages, in each database's placeholders."""

from __future__ import annotations

from dataclasses import dataclass, field

# How databases write the n-th argument.
PLACEHOLDERS = {"": "?", "mysql": "?", "sqlite": "?", "postgres": "${n}", "postgresql": "${n}", "sqlserver": "@p{n}", "mssql": "@p{n}", "oracle": ":p{n}"}


def placeholder(dialect: str, n: int) -> str:
    return PLACEHOLDERS.get(dialect.lower(), "?").replace("{n}", str(n))


@dataclass
class Select:
    """SELECT columns FROM table WHERE each condition ORDER BY order LIMIT limit, with its arguments in order."""

    table: str
    columns: tuple[str, ...] = ()
    where: list[tuple[str, str, object]] = field(default_factory=list)
    order: str = ""
    limit: int = 0
    dialect: str = ""

    def equals(self, column: str, value: object) -> Select:
        self.where.append((column, "=", value))
        return self

    def after(self, column: str, value: object) -> Select:
        self.where.append((column, ">", value))
        return self

    def build(self) -> tuple[str, list]:
        if not self.table:
            raise ValueError("a table is needed")
        out = f"SELECT {', '.join(self.columns) or '*'} FROM {self.table}"
        if self.where:
            out += " WHERE " + " AND ".join(f"{c} {op} {placeholder(self.dialect, n)}" for n, (c, op, _) in enumerate(self.where, 1))
        if self.order:
            out += f" ORDER BY {self.order} ASC"
        if self.limit > 0:
            out += f" LIMIT {self.limit}"
        return out, [v for _, _, v in self.where]


def tuple_query(table: str, group_id: int, date_key: str, limit: int = 1000, dialect: str = "postgres", columns: tuple[str, ...] = ("id", "term", "group_id", "date_key"), term: str | None = None) -> tuple[str, list]:
    made = Select(table, columns, order="id", limit=limit, dialect=dialect)
    if term is not None:
        made.equals("term", term)
    return made.equals("group_id", group_id).equals("date_key", date_key).build()


def tuple_page(table: str, partition_id: int, after: object, limit: int = 1000, dialect: str = "postgres", columns: tuple[str, ...] = ("id", "term", "group_id", "date_key")) -> tuple[str, list]:
    return Select(table, columns, order="id", limit=limit, dialect=dialect).equals("partition_id", partition_id).after("id", after).build()


def incremental_page(query: str, updated_at: object, id: object, limit: int = 1000, time_col: str = "updated_at", id_col: str = "id", dialect: str = "") -> tuple[str, list]:
    """``query`` past a high-water mark (time, id), in that order."""
    p = [placeholder(dialect, n) for n in (1, 2, 3)]
    joint = " AND " if " where " in query.lower() else " WHERE "
    return f"{query}{joint}({time_col} > {p[0]} OR ({time_col} = {p[1]} AND {id_col} > {p[2]})) ORDER BY {time_col}, {id_col} LIMIT {limit}", [updated_at, updated_at, id]
