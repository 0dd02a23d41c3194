"""JSON services as a data source: one partition a request, the transport injectable.

    spark.dataSource.register(JsonService)
    spark.read.format("json_service").option("urls", "...\\n...").option("transport", "package.module:function").load()

Credentials come from the environment variables named in the options `user_env` and `password_env`, never from a query."""

from __future__ import annotations

import base64
import importlib
import os
import urllib.parse
import urllib.request
from collections.abc import Iterator

from pyspark.sql.datasource import DataSource, DataSourceReader, InputPartition

# Seconds a service may take, and features asked for unless told otherwise.
TIMEOUTS = {"list": 10, "parcel": 15, "layer": 20}
MAX_FEATURES = 1000


def http_get(url: str, headers: dict[str, str], timeout: float) -> str:
    with urllib.request.urlopen(urllib.request.Request(url, headers=headers), timeout=timeout) as reply:
        return reply.read().decode("utf-8")


def feature_url(base: str, typename: str, bbox: tuple[float, float, float, float] | None = None, properties: tuple[str, ...] = (), max_features: int = MAX_FEATURES, srs: str = "EPSG:4326", request: str = "GetFeature", **extra: str) -> str:
    """Address of a feature service's request; box, columns and limit go to the service. Values are always escaped."""
    query = {"SERVICE": "WFS", "REQUEST": request, "TYPENAME": typename, "OUTPUTFORMAT": "application/json", "SRSNAME": srs, "MAXFEATURES": str(max_features)} | extra
    if bbox:
        query["BBOX"] = ",".join(map(str, bbox)) + f",{srs}"
    if properties:
        query["PROPERTYNAME"] = ",".join(properties)
    return f"{base}?{urllib.parse.urlencode(query)}"


def authorization(user: str, password: str) -> str:
    return "Basic " + base64.b64encode(f"{user}:{password}".encode()).decode()


class Request(InputPartition):
    def __init__(self, url: str) -> None:
        super().__init__(url)
        self.url = url


class JsonService(DataSource):
    """Rows (url, status, body): a failed request is a row with status `error`, so that a plan can degrade instead of ending."""

    @classmethod
    def name(cls) -> str:
        return "json_service"

    def schema(self) -> str:
        return "url string, status string, body string"

    def reader(self, schema) -> DataSourceReader:  # noqa: ANN001
        return JsonServiceReader(dict(self.options))


class JsonServiceReader(DataSourceReader):
    def __init__(self, options: dict[str, str]) -> None:
        self.options = options

    def partitions(self) -> list[Request]:
        return [Request(u) for u in self.options.get("urls", "").split("\n") if u.strip()]

    def read(self, partition: Request) -> Iterator[tuple[str, str, str]]:
        o, get = self.options, http_get
        if "transport" in o:
            module, _, function = o["transport"].partition(":")
            get = getattr(importlib.import_module(module), function)
        headers = {"User-Agent": "parcelforge", "Accept": "application/json"}
        if "user_env" in o:
            headers["Authorization"] = authorization(os.environ[o["user_env"]], os.environ[o["password_env"]])
        try:
            yield partition.url, "ok", get(partition.url, headers, float(o.get("timeout", TIMEOUTS["list"])))
        except Exception as e:
            yield partition.url, "error", str(e)
