"""Purchase amount and exact money sums."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Exact accumulator type for money: sums of doubles depend on the order rows
# arrive in, sums of decimals do not, so totals are the same on any cluster
# layout.  Amounts are rounded to micro-units before summing and totals to
# cents after.
MONEY_ACC = "decimal(38,6)"
MONEY_OUT = "decimal(38,2)"


def purchase_amount(price: Column | str = "price", quantity: Column | str = "quantity") -> Column:
    """``price * quantity`` as a double (the same IEEE product Python computes)."""
    price = F.col(price) if isinstance(price, str) else price
    quantity = F.col(quantity) if isinstance(quantity, str) else quantity
    return price * quantity


def to_money_acc(amount: Column) -> Column:
    """Exact accumulator value; null for NaN, infinity and amounts beyond the accumulator."""
    return amount.try_cast(MONEY_ACC)


def is_readable(amount: Column) -> Column:
    """An amount that can be added up; anything else is treated like an unreadable price."""
    return to_money_acc(amount).isNotNull()


def money_total(acc: Column) -> Column:
    """Decimal accumulator -> the double reported to users (cents exact)."""
    return acc.cast(MONEY_OUT).cast("double")


def money_sum(amount: Column | str = "amount") -> Column:
    """Aggregate: exact sum of double amounts, reported as a double; 0 when empty.

    Unreadable amounts add nothing.  A sum beyond the accumulator's range is
    reported as the sum of doubles instead of failing the query.
    """
    amount = F.col(amount) if isinstance(amount, str) else amount
    acc = to_money_acc(amount)
    return (F.when(F.count(acc) == 0, F.lit(0.0))
            .otherwise(F.coalesce(money_total(F.try_sum(acc)),
                                  F.sum(F.when(acc.isNotNull(), amount.cast("double"))))))
