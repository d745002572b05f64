"""The store of standing tasks: a small document that is read and published as a whole (SK10)."""

from __future__ import annotations

from pathlib import Path

from frameloom.sources.logs import _items, publish, task_rows


class TaskStore:
    """Tasks by id in order of registration. A change is checked before it is written, so a refused one leaves the store as it was."""

    def __init__(self, path: str, actions: tuple[str, ...] | None = None) -> None:
        self.path, self.actions = path, actions

    def all(self) -> list[dict]:
        """Every task, disabled ones included; none where there is no store yet."""
        return _items(self.path) if Path(self.path).exists() else []

    def enabled(self) -> list[dict]:
        return [t for t in self.all() if t.get("enabled", True)]

    def register(self, task: dict) -> None:
        """Add a task; an id that is taken raises."""
        self._write([*self.all(), dict(task)])

    def update(self, task_id: str, /, **changes) -> bool:
        """Change a task; whether its wording changed, so that it needs a new vector. The id itself cannot change."""
        if changes.get("task_id", task_id) != task_id:
            raise ValueError("the id of a task cannot change")
        tasks = self.all()
        at = self._place(tasks, task_id)
        before, tasks[at] = tasks[at], tasks[at] | changes
        self._write(tasks)
        return tasks[at].get("describe") != before.get("describe")

    def remove(self, task_id: str) -> None:
        tasks = self.all()
        tasks.pop(self._place(tasks, task_id))
        self._write(tasks)

    def set_enabled(self, task_id: str, enabled: bool) -> None:
        self.update(task_id, enabled=bool(enabled))

    @staticmethod
    def _place(tasks: list[dict], task_id: str) -> int:
        for i, t in enumerate(tasks):
            if t.get("task_id") == task_id:
                return i
        raise KeyError(task_id)

    def _write(self, tasks: list[dict]) -> None:
        task_rows(tasks)
        for t in tasks:
            if not str(t["task_id"]).strip() or not str(t["describe"]).strip():
                raise ValueError("a task needs an id and a description")
            if self.actions is not None and t["action"] not in self.actions:
                raise ValueError(f"task {t['task_id']!r} has an unknown action")
        publish(self.path, {"tasks": tasks})
