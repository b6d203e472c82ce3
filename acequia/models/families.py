"""The families this library brings along."""

from __future__ import annotations

from functools import partial

from acequia.models import sarima, var
from acequia.models.family import Family, register


def _multivariate(models, history, horizon, policy):
    return var.forecast(models, history, horizon)


def _seasonal_fit(pack, config, stations=None, *, family):
    return sarima.fit(pack, config, family, stations)


def _multivariate_fit(pack, config, stations=None, *, family):
    return var.fit(pack, config, family, stations)


for _name in ("sarima", "sarimax"):
    register(Family(_name, partial(_seasonal_fit, family=_name), sarima.forecast))
for _name in ("var", "window"):
    register(Family(_name, partial(_multivariate_fit, family=_name), _multivariate))
