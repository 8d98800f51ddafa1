"""massq.operators"""
