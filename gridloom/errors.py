"""Errors with a stable code and an English message."""

from __future__ import annotations

# Error codes and messages.
MESSAGES = {
    "syntax": "line {row}, column {col}: {detail}",
    "need_kind": "{what} needs {want}, got {got}",
    "unknown_agg": "unknown aggregation {agg}",
    "not_expanded": "{what} (dimensions {own}) lacks {missing}; write EXPAND to copy it to all members, or ON to take another metric's cells",
    "unknown_member": "{dim} has no member {member!r}",
    "operand_kinds": "the sides of {op} differ in kind: {left} and {right}",
    "unordered_compare": "{op}: {dim} is not an ordered dimension",
    "if_kinds": "THEN and ELSE differ in kind: {kinds}",
    "filter_dims": "the condition of FILTER has dimensions {extra} that its metric lacks",
    "expand_present": "EXPAND {dim}: already a dimension",
    "expand_repeated": "EXPAND {dims}: a dimension is repeated",
    "coalesce_mismatch": "the cells and what stands in for blanks differ: {first} and {second}",
    "ifblank_kind": "the default of IFBLANK must be {kind}",
    "no_property_or_metric": "{dim} has no property {prop}, and no metric has that name",
    "by_target_present": "{what}: {target} is already a dimension",
    "by_lookup_agg": "{what}: a lookup takes no aggregation",
    "by_no_dims": "{what}: the dimensions {dims} include neither {dim} nor {target}",
    "by_not_member": "{what}: {prop} is not a member metric ({kind})",
    "by_metric_no_dim": "{what}: the dimensions {dims} of {prop} lack {dim}",
    "by_metric_missing": "{what}: the expression lacks the dimensions {missing} of {prop}",
    "remove_absent": "REMOVE {dim}: not among the dimensions {dims}",
    "previous_absent": "{dim}: not among the dimensions {dims}",
    "previous_unordered": "{dim} is not an ordered dimension",
    "select_absent": "SELECT {dim}: not among the dimensions {dims}",
    "unknown_dim": "unknown dimension {name}",
    "unknown_metric": "unknown metric {name}",
    "formula_dims": "{metric}: the formula has dimensions {dims}, declared are {declared}",
    "formula_kind": "{metric}: the formula is {kind}, declared is {declared}",
    "too_many_cells": "{metric}: up to {cells:,.0f} cells, the limit is {limit:,}",
    "cycle_no_lag": "circular reference without a time lag: {members}",
    "cycle_scan_dim": "circular reference: {src} lacks the scanned dimension {dim}",
    "cycle_broken": "circular reference: {dim} is aggregated or replaced on the way",
    "cycle_future": "circular reference: {src} refers to the future of {target}",
    "cycle_same_time": "circular reference within one period: {members}",
    "sql_syntax": "SQL syntax: {detail}",
    "sql_statements": "one SELECT statement is expected",
    "sql_too_complex": "the query has {count} tokens, the limit is {max}",
    "sql_columns": "the query has {count} columns, the limit is {max}",
    "sql_unsupported": "SQL: {what} is not supported",
    "sql_from": "FROM takes only model, not {name}",
    "sql_unknown": "no dimension or metric is named {name}",
    "sql_ambiguous": "ORDER BY {name} fits several columns",
    "sql_not_dim": "{name} is not a dimension (aggregate metrics)",
    "sql_not_metric": "{name} is not a metric",
    "sql_not_grouped": "{name} is not in GROUP BY",
    "sql_position": "position {pos} is not one of the {n} columns",
    "sql_group_position": "position {pos} in GROUP BY is not a dimension",
    "sql_no_aggregate": "SELECT needs at least one aggregate",
    "sql_kind": "{metric} is {kind}, so {agg} does not apply",
    "sql_member": "{dim} has no member {member!r}",
    "sql_missing_dim": "metric {metric} lacks the dimension {dim}",
    "sql_order": "ORDER BY {name} is neither a column nor a grouped dimension",
    "sql_too_large": "the result has {cells} cells, the limit is {max}",
}


class FormulaError(ValueError):
    def __init__(self, code: str, **values):
        self.code, self.values = code, values
        super().__init__(f"{code}: {MESSAGES[code].format(**values)}")


class SqlError(FormulaError):
    pass
