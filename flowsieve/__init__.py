"""flowsieve: network-flow and access-rule analytics as Spark DataFrame jobs."""

from flowsieve.plans.analyzer import FlowAnalyzer

__all__ = ["FlowAnalyzer"]
