"""Queries: whole plans made of operators, for source trees and for the driver's tables."""
