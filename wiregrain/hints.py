"""Advice that goes with a result: what to call next, or why it is empty."""

from __future__ import annotations


def search(total: int, shown: int, offset: int = 0) -> str:
    if not total:
        return "Nothing found. Ask for less: fewer filters, fewer words."
    if offset + shown < total:
        return f"{total - offset - shown} more entries; continue with offset={offset + shown}."
    return ""


def endpoints(total: int, shown: int, categories: dict[str, int], graphql: int = 0) -> str:
    if not total:
        return "The scope holds no endpoint."
    parts = [f"{n} {c}" for c, n in sorted(categories.items(), key=lambda x: (-x[1], x[0]))]
    out = [f"{total} endpoints: {', '.join(parts)}."] if parts else []
    if shown < total:
        out.append(f"{shown} are listed; limit and offset give the others.")
    if graphql:
        out.append(f"{graphql} endpoints carry GraphQL; see survey_graphql().")
    return " ".join(out)


_TRY = {
    "jq": "The expression '.' shows a whole body.",
    "css": "The selector '*' shows every element.",
    "xpath": "The path '//*' shows every element.",
}


def query(values: int, processed: int, mode: str = "", errors: int = 0, truncated: bool = False) -> str:
    out = []
    if not values and processed:
        used = f" (read as {mode})" if mode else ""
        out.append(f"{processed} bodies, none with a value{used}. {_TRY.get(mode, 'Name the mode if the wrong one was chosen.')}")
    if truncated:
        out.append("There is more than the limit lets through; raise it or name fewer entries.")
    if errors and values:
        out.append(f"{errors} bodies failed, so values of them are missing.")
    return " ".join(out)


def graphql(failing: list[str], first: str = "") -> str:
    out = [f"Failing operations: {', '.join(failing)} (section 'errors')."] if failing else []
    if first:
        out.append(f"inspect_graphql_operation({first!r}) tells more.")
    return " ".join(out)
