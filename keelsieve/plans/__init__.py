"""keelsieve.plans"""
