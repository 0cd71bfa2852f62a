"""Document analytics on Spark: conversion, inspection and corpus preparation as DataFrame operators."""

__version__ = "0.1.0"
