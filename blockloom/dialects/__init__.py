"""The query dialects, by the name a query's ``type`` gives."""

from __future__ import annotations

from blockloom.dialects import bitcoin, evm, fuel, hyperliquid, solana, substrate, tron

DIALECTS = {d.name: d for d in (bitcoin.BITCOIN, evm.EVM, solana.SOLANA, substrate.SUBSTRATE, fuel.FUEL, hyperliquid.FILLS, hyperliquid.REPLICA_COMMANDS, tron.TRON)}
