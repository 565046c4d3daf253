"""Composition of check queries from named common table expressions."""

from __future__ import annotations


class Views:
    """Named CTEs with their dependencies; ``query`` prepends those a statement needs."""

    def __init__(self) -> None:
        self._bodies: dict[str, tuple[str, tuple[str, ...]]] = {}

    def add(self, name: str, body: str, *needs: str) -> None:
        self._bodies[name] = (body, needs)

    def query(self, body: str, *needs: str) -> str:
        ordered: list[str] = []

        def visit(name: str) -> None:
            if name in ordered:
                return
            for need in self._bodies[name][1]:
                visit(need)
            ordered.append(name)

        for name in needs:
            visit(name)
        parts = [f"{name} AS ({self._bodies[name][0]})" for name in ordered]
        return ("WITH RECURSIVE " + ",\n".join(parts) + "\n" if parts else "") + body
