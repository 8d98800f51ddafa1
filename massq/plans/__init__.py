"""massq.plans"""
