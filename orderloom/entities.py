"""The four entities: columns, keys and references."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import types as T


@dataclass(frozen=True)
class ForeignKey:
    column: str
    parent: str
    parent_column: str


@dataclass(frozen=True)
class Entity:
    """One table. ``raw`` is its schema as ingested; ``timestamps`` are typed on cleansing.

    Columns that are not nullable in ``raw`` are required: a row without a value in
    one of them cannot be ingested.
    """

    name: str
    raw: T.StructType
    primary_key: tuple[str, ...]
    foreign_keys: tuple[ForeignKey, ...] = ()
    timestamps: tuple[str, ...] = ()

    @property
    def required(self) -> tuple[str, ...]:
        return tuple(f.name for f in self.raw.fields if not f.nullable)


def _schema(**columns: T.DataType) -> T.StructType:
    # Numbers are required, text is not.
    return T.StructType(
        [T.StructField(n, t, isinstance(t, T.StringType)) for n, t in columns.items()]
    )


def order_entities(id_type: T.DataType | None = None) -> dict[str, Entity]:
    """The order model, parents before children.

    Ids are int unless ``id_type`` says otherwise; tables with more rows than an int
    can number want bigint.
    """
    key = id_type or T.IntegerType()
    text, whole, real = T.StringType(), T.IntegerType(), T.DoubleType()
    entities = (
        Entity("region", _schema(regionId=key, regionName=text), ("regionId",)),
        Entity(
            "product",
            _schema(productId=key, productName=text, category=text, unitPrice=real),
            ("productId",),
        ),
        Entity(
            "order",
            _schema(orderId=key, orderTs=text, regionId=key, customerId=key, status=text),
            ("orderId",),
            (ForeignKey("regionId", "region", "regionId"),),
            ("orderTs",),
        ),
        Entity(
            "order_details",
            _schema(orderDetailId=key, orderId=key, productId=key, quantity=whole, unitPrice=real),
            ("orderDetailId",),
            (
                ForeignKey("orderId", "order", "orderId"),
                ForeignKey("productId", "product", "productId"),
            ),
        ),
    )
    return {e.name: e for e in entities}
