"""Sorting by named keys, some of them masked or reversed."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions import fields as X
from ..functions.addresses import v4_net

#: Names of sort keys.
KEYS = """
    stime ltime trans dur mean min max smacclass dmacclass saddr daddr proto sipid dipid sport dport stos dtos sttl dttl
    bytes sbytes dbytes pkts spkts dpkts appbytes sappbytes dappbytes load sload dload loss ploss rate srate drate tranref
    seq smpls dmpls svlan dvlan srcid stcpb dtcpb tcprtt sloss dloss sploss dploss smaxsz sminsz dmaxsz dminsz sdsb ddsb
    sco dco sas das sum runtime idle soui doui abr pcr inode loc sloc dloc shops dhops smask dmask sid inf score compare
    smac dmac intflow intflowsdev nstroke snstroke dnstroke spktsz dpktsz""".split()


def order(spec: str, columns: set[str], reverse: bool = False) -> list[Column]:
    """Sort columns of a list such as '-bytes saddr/24 +stime'; '-' is descending, ``reverse`` turns all of them.

    IPv4 addresses sort by number, before all others, which sort by text; '/len' compares their leading bits only. Nulls
    come last in either direction.
    """
    out = []
    for word in spec.split():
        down = (word[0] == "-") != reverse
        name, _, length = word.lstrip("+-").partition("/")
        if name not in KEYS and name not in columns:
            raise KeyError(f"no sort key {name!r}")
        if name in ("saddr", "daddr"):
            number = F.col(f"{name}_i")
            parts = [v4_net(number, int(length)) if length else number, F.when(number.isNull(), F.col(name))]
        elif length:
            raise ValueError(f"only addresses take a mask, not {name!r}")
        else:
            parts = [F.expr(X.sql(name, columns))]
        out += [p.desc_nulls_last() if down else p.asc_nulls_last() for p in parts]
    return out


def sort(df: DataFrame, spec: str, reverse: bool = False) -> DataFrame:
    """All records in the order of the keys. Ties stay in no particular order; end the list with 'seq' or 'autoid' to fix it.

    A range exchange by sampled bounds and a sort of each range, which spills where it must.
    """
    return df.orderBy(*order(spec, set(df.columns), reverse))
