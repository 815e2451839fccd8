"""Parameters of estimators."""

from __future__ import annotations


class Estimator:
    """Keyword parameters with defaults; what is fitted is in attributes that end in an underscore."""

    defaults: dict = {}

    def __init__(self, **params):
        unknown = set(params) - set(self.defaults)
        if unknown:
            raise TypeError(f"unknown parameters {sorted(unknown)}")
        self.params = dict(self.defaults) | params

    def getParams(self) -> dict:
        return dict(self.params)

    def setParams(self, **params):
        self.__init__(**(self.params | params))
        return self

    def __getattr__(self, name: str):
        params = self.__dict__.get("params", {})
        if name in params:
            return params[name]
        raise AttributeError(f"{name} is unknown, or {type(self).__name__} isn't fitted")
